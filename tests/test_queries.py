"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from marginalia.plans import registry
from marginalia.sources.files import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def table(rows, names, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = table([tuple(r) for r in df.collect()], df.columns, order)
    if name in registry.ORACLES:
        cur = duck.execute(registry.ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == order
        assert got == table(cur.fetchall(), names, order)
    else:
        assert got


def test_audit_assignment_of_a_document_without_flags(spark, tmp_path):
    # turns of a ninth of the text each, 100 minutes apart, in a conversation that starts in the evening
    rows = [(3, 25 * k, "user", "word " * 20) for k in range(9)] + [(6, 0, "user", "all at once")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cur = con.execute(registry.ORACLES["audit_assignment"])
    df = registry.QUERIES["audit_assignment"](spark, str(tmp_path))
    names = [c[0] for c in cur.description]
    got = table([tuple(r) for r in df.collect()], df.columns, names)
    assert got == table(cur.fetchall(), names, names)
    assert [r[names.index("flag_count")] for r in got if r[names.index("conv_id")] == 3] == [0]


def test_burst_editing_does_not_hang_on_the_order_of_rows(spark, tmp_path):
    import itertools

    day = [("2024-01-28 04:13:57", 6.53), ("2024-01-28 04:27:23", 12.54), ("2024-01-28 18:18:50", 19.11), ("2024-01-28 21:44:11", 57.27)]  # the last is 0.6 of all
    for k, rows in enumerate(itertools.permutations(enumerate(day))):
        rows = [(i, ts, 273 + 1000 * k, v) for i, (ts, v) in rows]
        spark.createDataFrame(rows, "event_id long, t string, user_id long, value double").coalesce(1).selectExpr("event_id", "cast(t as timestamp_ntz) as ts", "user_id", "value").write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert registry.QUERIES["burst_editing"](spark, str(tmp_path)).collect() == []
