"""Sources, sinks and streams."""

import datetime
import json

from marginalia.sources import files
from marginalia.streaming import events as streams


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    files.write_jsonl(df, str(tmp_path / "j"))
    files.write_jsonl(df.limit(1), str(tmp_path / "j"), append=True)
    got = files.read_jsonl(spark, str(tmp_path / "j"), "id int, v string")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a"), (1, "a"), (2, None)]
    line = next(p for p in (tmp_path / "j").glob("*.json") if "null" in p.read_text()).read_text()
    assert '"v":null' in line


def test_roster_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("ID, First_Name ,last_name,email\n7, Ann ,Lee,a@x\n8,Bob,Ray,\n")
    got = files.read_roster(spark, str(tmp_path / "r.csv")).orderBy("position").collect()
    assert [(r["id"], r["first_name"], r["last_name"], r["grade"], r["email"]) for r in got] == [("7", "Ann", "Lee", None, "a@x"), ("8", "Bob", "Ray", None, None)]


def test_texts_and_skip_lists(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "ann.v2.txt").write_text("Text\nmore")
    (folder / "bob.txt").write_text(" \n")
    (folder / "c.md").write_text("no")
    some, blank = files.read_texts(spark, str(folder))
    assert [tuple(r) for r in some.collect()] == [("ann.v2", "Text\nmore")] and [r[0] for r in blank.collect()] == ["bob"]
    (tmp_path / "skip.json").write_text('["Ann", "Bob"]')
    (tmp_path / "bad.json").write_text("not json")
    names = lambda p: sorted(r["name"] for r in files.read_skip_list(spark, str(tmp_path / p)).collect())
    assert names("skip.json") == ["Ann", "Bob"] and names("bad.json") == names("none.json") == []


def test_discovery_and_isolation(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "a" / "x.PDF").write_bytes(b"one")
    (deep / "y.pdf").write_bytes(b"bad")
    (deep / "z.txt").write_bytes(b"no")
    found, missing = files.discover(spark, [str(tmp_path / "a"), str(tmp_path / "none")])
    assert missing == [str(tmp_path / "none")] and found.count() == 2
    assert files.discover(spark, [str(tmp_path / "none")])[0].count() == 0

    def read(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode()

    texts, failed = files.each_file(found, read, "text", "string")
    assert [r["text"] for r in texts.collect()] == ["one"]
    assert [(r["path"].rsplit("/", 1)[1], r["reason"]) for r in failed.collect()] == [("y.pdf", "ValueError: broken")]


def test_gradebook_and_base64(spark, tmp_path):
    files.write_gradebook(spark.createDataFrame([("a", 1.5)], "name string, score double"), str(tmp_path / "g"))
    assert next((tmp_path / "g").glob("*.csv")).read_text() == "name,score\na,1.5\n"
    got = files.fetch_base64(spark.createDataFrame([(b"abc",)], "content binary")).first()
    assert (got["size"], got["base64"]) == (3, "YWJj")


def _stream(spark, tmp_path, rows):
    at = lambda m: datetime.datetime(2024, 1, 1, 12, m).isoformat()
    folder = tmp_path / "in"
    folder.mkdir()
    for n, part in enumerate(rows):
        (folder / f"{n}.json").write_text("".join(json.dumps({"k": k, "ts": at(m), "value": v}) + "\n" for k, m, v in part))
    return spark.readStream.schema("k string, ts timestamp, value double").option("maxFilesPerTrigger", 1).json(str(folder))


def _run(spark, df, tmp_path, mode, name):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_streams_equal_their_batch_forms(spark, tmp_path):
    rows = [[("a", 0, 1.0), ("b", 1, 2.0)], [("a", 4, 3.0), ("a", 45, 5.0)]]
    events = _stream(spark, tmp_path, rows)
    totals = _run(spark, streams.sliding_totals(events, "k", size="10 minutes", slide="5 minutes"), tmp_path, "complete", "totals")
    assert {(r["k"], r["window"]["start"].minute, r["total"]) for r in totals if r["window"]["start"].hour == 12} == {("a", 0, 4.0), ("b", 0, 2.0), ("a", 40, 5.0), ("a", 45, 5.0)}
    found = _run(spark, streams.sessions(events, "k"), tmp_path, "complete", "sessions")
    assert sorted((r["k"], r["n"]) for r in found) == [("a", 1), ("a", 2), ("b", 1)]
    assert len(_run(spark, streams.once(events, ["k"]), tmp_path, "append", "once")) == 2


def test_batches_are_delivered(spark, tmp_path):
    events, seen = _stream(spark, tmp_path, [[("a", 0, 1.0)], [("b", 1, 1.0)]]), []
    streams.deliver(events, lambda df, batch: seen.append((batch, df.count())), str(tmp_path / "d")).awaitTermination()
    assert seen == [(0, 1), (1, 1)]
