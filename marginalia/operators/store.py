"""Record-store operators, set-oriented: one plan over all parents, with the
single-parent call a filter on top."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema`` in order: missing ones null, known ones cast."""
    target = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of those given; without any, always true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def matching(columns, query: str | None, wildcards: bool = False) -> Column | None:
    """Any of the columns holds the query."""
    if not query:
        return None
    return reduce(lambda a, b: a | b, [(T.like if wildcards else T.holds)(c, query) for c in columns])


def until(column: str, end: str, whole_day: bool = False) -> Column:
    """Up to ``end``.  A bare date leaves out what happens on that day, unless
    ``whole_day``, which leaves out its last microsecond only."""
    bound = F.lit(f"{end}T23:59:59.999999" if whole_day else end).cast("timestamp_ntz")
    return F.col(column) < bound if whole_day else F.col(column) <= bound


def page(df: DataFrame, order: str, sortable: dict[str, str], key: str, descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page with the count of all rows as ``total``; past the last page
    one row with the total and nulls.

    ``sortable`` names the columns that a caller may sort by; another order
    takes the first.  Ties by ``key``, so that pages don't overlap.  The count
    is an aggregate of its own, so that no window holds all rows."""
    column = sortable.get(order, next(iter(sortable.values())))
    by = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first()
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(by, F.col(key).asc()).offset(offset).limit(limit)
    return total.join(rows, F.lit(True), "left")  # one row: past the last page the total comes alone


def latest(df: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    """Last row of each key; null keys are keys too.  Rows of a key meet after
    each partition has kept its own last one."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(by, tie)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def with_counts(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    """Parents with the number of their children and whether there are any."""
    n = children.groupBy(F.col(foreign).alias("_key")).agg(F.count(F.lit(1)).alias(name))
    joined = parents.join(n, parents[key] == n["_key"], "left").drop("_key")
    return joined.withColumn(name, F.coalesce(name, F.lit(0)).cast("long")).withColumn(f"has_{name}", F.col(name) > 0)


def search(joined: DataFrame, query: str, job: list[str], ladder: list[tuple[str, str]], content: str, row_key: list[str], most: int = 3) -> DataFrame:
    """Matches per job: reason and snippet of the first ``most`` rows.

    ``ladder``: (column, reason) in order of precedence; a hit in ``content``
    alone is a content match.  Only the cap's rows of a job meet."""
    hit = matching([c for c, _ in ladder] + [content], query)
    reason = T.match_reason(query, *ladder)
    shown = T.snippet(content, query)
    for column, why in reversed(ladder):
        shown = F.when(reason == why, F.col(column)).otherwise(shown)
    rows = joined.where(hit).select(*job, *[k for k in row_key if k not in job], reason.alias("reason"), shown.alias("snippet")).distinct()
    w = Window.partitionBy(*job).orderBy(*row_key, "reason", "snippet")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(*job, F.col("rank").cast("long").alias("rank"), "reason", "snippet")


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Sparse update: non-null columns of ``changes`` replace those of base."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    joined = base.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in joined.columns else F.col(c) for c in base.columns])


def replace_by_key(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of all rows of base with their keys."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def cascade(tables: dict[str, DataFrame], children: dict[str, list[tuple[str, str]]], table: str, key: str, gone: DataFrame, keys: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """``tables`` without the rows of ``table`` whose key is in ``gone`` (one
    column) and without what hangs from them, however deep.

    ``children``: for each table its children and their foreign keys.
    ``keys``: the key of each child that has children itself, ``id`` if not
    named.  A null foreign key hangs from nothing."""
    left, keys = dict(tables), {**(keys or {}), table: key}

    def fall(name: str, column: str, ids: DataFrame) -> None:
        rows = left[name]
        for child, foreign in children.get(name, ()):
            if child in left:
                own = keys.get(name, "id")
                below = ids if column == own else rows.join(ids, F.col(column) == F.col("_gone"), "left_semi").select(F.col(own).alias("_gone")).distinct()
                fall(child, foreign, below)
        left[name] = left[name].join(ids, F.col(column) == F.col("_gone"), "left_anti")

    fall(table, key, gone.select(F.col(gone.columns[0]).alias("_gone")).distinct())
    return left


def archive(df: DataFrame, ids: list | DataFrame, to: bool = True, key: str = "id") -> DataFrame:
    """Soft delete or restore; ``changed`` tells which rows it changed.
    ``ids``: a list, or a table of one column."""
    if isinstance(ids, DataFrame):
        marked = df.join(ids.select(F.col(ids.columns[0]).alias("_id"), F.lit(True).alias("_named")).distinct(), F.col(key) == F.col("_id"), "left")
        hit = F.coalesce("_named", F.lit(False)) & (F.coalesce("archived", F.lit(False)) != to)
        out = marked.withColumn("changed", hit)
        return out.withColumn("archived", F.when(F.col("changed"), to).otherwise(F.coalesce("archived", F.lit(False)))).select(*df.columns, "changed")
    hit = F.coalesce(F.col(key).isin(*ids), F.lit(False)) & (F.coalesce("archived", F.lit(False)) != to)
    return df.withColumn("changed", hit).withColumn("archived", F.when(F.col("changed"), to).otherwise(F.coalesce("archived", F.lit(False))))


def set_entry(metadata, key: str, value) -> Column:
    """A map with one entry set; the new value wins."""
    old = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.map_concat(old, F.create_map(F.lit(key), value.cast("string")))


def merge_words(old, new, replace: bool = False) -> Column:
    """Custom words in sorted order: the union, or the new ones alone."""
    empty = F.array().cast("array<string>")
    new = F.coalesce(new, empty)
    return F.array_sort(F.array_distinct(new if replace else F.array_union(F.coalesce(old, empty), new)))


def advance(status, sequence: list[tuple[str, str]]) -> Column:
    """Next status, only from the one it follows."""
    out = status
    for now, then in sequence:
        out = F.when(status == now, then).otherwise(out)
    return out


def guarded(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a precondition, and the others; null is not met."""
    ok = F.coalesce(condition, F.lit(False))
    return df.where(ok), df.where(~ok)


def older_than(df: DataFrame, column: str, now: str, days: int = 210) -> DataFrame:
    """Rows past their retention, as of ``now``."""
    return df.where(F.col(column) < F.expr(f"timestamp_ntz'{now}' - interval {int(days)} days"))


def record_id(prefix: str, at, *seed) -> Column:
    """``prefix_YYYYmmdd_HHMMSS_`` and eight hex digits of what is inserted,
    so that a retried insert gives the same id."""
    return F.concat_ws("_", F.lit(prefix), F.date_format(at, "yyyyMMdd_HHmmss"), F.substring(F.sha2(F.concat_ws("\x1f", *seed), 256), 1, 8))


def counted(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """Rows of each group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def partitioned_counts(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """Rows of each group in all, under each condition, and under none
    (``other``).  Null meets no condition."""
    none = reduce(lambda a, b: a & b, [~F.coalesce(c, F.lit(False)) for c in conditions.values()], F.lit(True))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()], F.count_if(none).alias("other"))


def listed(df: DataFrame, names: DataFrame, column: str, inside: bool = True) -> DataFrame:
    """Rows whose ``column`` is (or is not) in the one column of ``names``."""
    keys = names.select(F.col(names.columns[0]).alias("_listed")).distinct()
    return df.join(keys, F.col(column) == F.col("_listed"), "left_semi" if inside else "left_anti")


def first_seen(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """Ordered distinct: each group's first position and its rows."""
    return df.groupBy(*by).agg(F.min(position).alias(position), F.count(F.lit(1)).alias("copies"))


def numbered_children(parents: DataFrame, children: DataFrame, on: Column, within: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Parents with their children, if any, numbered in order within a group;
    nulls come first."""
    w = Window.partitionBy(*within).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return parents.join(children, on, "left").withColumn(name, F.row_number().over(w).cast("long"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a primary key."""
    return df.where(F.col(key) == F.lit(value))


def children_of(df: DataFrame, foreign: str, parent, order: list[str], status: list[str] = ()) -> DataFrame:
    """A parent's rows in order, of the given states if any are given."""
    rows = df.where(F.col(foreign) == F.lit(parent))
    return (rows.where(F.col("status").isin(*status)) if status else rows).orderBy(*order)


def without(df: DataFrame, heavy: list[str]) -> DataFrame:
    """Metadata alone: all columns but the heavy ones."""
    return df.drop(*heavy)


def owned(rows: DataFrame, key: str, foreign: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (key, foreign) with ``verdict``: ``ok``, ``not found``, or
    ``not owned`` where the row belongs to another parent."""
    found = rows.select(F.col(key), F.col(foreign).alias("_parent"), F.lit(True).alias("_found"))
    verdict = F.when(F.col("_found").isNull(), "not found").when(F.col("_parent").eqNullSafe(F.col(foreign)), "ok").otherwise("not owned")
    return wanted.join(found, key, "left").select(*wanted.columns, verdict.alias("verdict"))


def refreshed(parents: DataFrame, children: DataFrame, key: str, foreign: str, counters: dict[str, Column]) -> DataFrame:
    """Parents with their counters recounted from their children, each over
    the children that meet its condition; without any, 0."""
    n = children.groupBy(F.col(foreign).alias("_key")).agg(*[F.count_if(c).alias(f"_n_{name}") for name, c in counters.items()])
    joined = parents.drop(*counters).join(n, F.col(key) == F.col("_key"), "left")
    return joined.select(*[c for c in parents.columns if c not in counters], *[F.coalesce(f"_n_{name}", F.lit(0)).cast("long").alias(name) for name in counters])


def incremented(df: DataFrame, events: DataFrame, key: str, counter: str) -> DataFrame:
    """A counter raised by the events of its row; null counts as 0."""
    n = events.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    joined = df.join(n, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(counter, (F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long")).select(*df.columns)


def resolved(wanted: DataFrame, stores: list[DataFrame], key: str) -> DataFrame:
    """Each wanted key with its row of the first store that has one, and the
    store's place in ``found_in`` (null: none has it)."""
    columns = [c for c in stores[0].columns if c != key]
    rows = reduce(DataFrame.unionByName, [s.select(key, *columns).withColumn("_store", F.lit(i)) for i, s in enumerate(stores)])
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns, "_store"), "_store").alias("_row"))
    return wanted.join(best, key, "left").select(*wanted.columns, *[F.col("_row")[c].alias(c) for c in columns], F.col("_row")["_store"].alias("found_in"))


def stamped(df: DataFrame, ids: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """Rows whose key is in ``ids`` with a new ``status`` and ``updated_at``."""
    change = ids.select(F.col(ids.columns[0]).alias(key)).distinct().select(key, F.lit(status).alias("status"), F.lit(at).cast("timestamp_ntz").alias("updated_at"))
    return patch(df, change, key)


def purged(tables: dict[str, DataFrame], children: dict[str, list[tuple[str, str]]], table: str, key: str, column: str, now: str, days: int = 210, keys: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """``tables`` without what is past its retention and what hangs from it,
    and the rows of ``table`` that went."""
    gone = older_than(tables[table], column, now, days)
    return cascade(tables, children, table, key, gone.select(key), keys), gone
