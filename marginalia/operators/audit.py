"""Edit-history audit: one plan over all documents' revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .replies import parse_time, wall_clock

# fixed values: thresholds of the audit
BULK, FEW_WORDS, FEW_REVISIONS, BURST, BURST_MINUTES, COLD = 0.20, 300, 3, 0.60, 10, 0.80
DAY_START, DAY_END, DEADLINE_HOURS = 6, 23, 2
SEVERITY = {"bulk_insertion": "high", "few_revisions": "medium", "burst_editing": "high", "cold_start": "medium", "timing_off_hours": "low", "deadline_crunch": "medium"}


# fixed values: descriptions of the flags
DESCRIPTIONS = {
    "bulk_insertion": "Revision %d added %d characters (%d%% of final document) in one step.",
    "few_revisions": "Document has %d words but only %d revision(s).",
    "burst_editing": "%d%% of final content added within a 10-minute window.",
    "cold_start": "First revision already contained %d%% of the final document length with minimal subsequent editing.",
    "timing_off_hours": "All %d edits occurred outside 6:00–23:00.",
    "deadline_crunch": "All edits occurred within 2 hours of the deadline.",
}
#: Fixed value: characters of a snippet.
SNIPPET = 180


def bursts(revisions: DataFrame, keys: list[str], ts: str, added: str, final: str, share: float = BURST, minutes: int = BURST_MINUTES) -> DataFrame:
    """First start of a window, both ends included, whose added characters
    are more than ``share`` of the final length, for each document."""
    seconds = F.col(ts).cast("timestamp").cast("double")
    w = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(0, minutes * 60)
    inside = revisions.withColumn("window_added", F.sum(added).over(w))
    return inside.where((F.col(final) > 0) & (F.col("window_added") / F.col(final) > share)).groupBy(*keys).agg(F.min(ts).alias("burst_start"), F.min_by("window_added", ts).alias("burst_added"))


def off_hours(ts) -> Column:
    """Aggregate: more than one edit, and every one outside the day."""
    hour = F.hour(ts)
    return F.every((hour < DAY_START) | (hour >= DAY_END)) & (F.count(F.lit(1)) > 1)


def deadline_crunch(ts, deadline) -> Column:
    """Aggregate: every edit within hours before the deadline, ends included.
    An unparsable (null) time anywhere: no flag."""
    left = deadline.cast("timestamp").cast("double") - F.col(ts).cast("timestamp").cast("double")
    return F.coalesce(F.every(F.coalesce(left.between(0, DEADLINE_HOURS * 3600), F.lit(False))), F.lit(False))


def revision_flags(revisions: DataFrame, key: str) -> DataFrame:
    """Flags of each document from (key, rev_no, added, length, words).

    ``length`` and ``words`` are of the whole text after the revision.
    Returns key, revision_count, final_words, bulk (revisions flagged), few,
    cold, flag_count, max_severity."""
    ends = revisions.groupBy(key).agg(
        F.count(F.lit(1)).alias("revision_count"),
        F.max_by("length", "rev_no").alias("final_length"),
        F.max_by("words", "rev_no").alias("final_words"),
        F.min_by("length", "rev_no").alias("first_length"),
    )
    joined = revisions.select(key, "added").join(ends, key)
    share = F.col("added") / F.col("final_length")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    flagged = joined.groupBy(key, "revision_count", "final_length", "final_words", "first_length").agg(F.count_if((F.col("final_length") > 0) & (share > BULK)).alias("bulk"))
    few = one((F.col("final_words") >= FEW_WORDS) & (F.col("revision_count") <= FEW_REVISIONS))
    cold = one((F.col("final_length") > 0) & (F.col("first_length") / F.col("final_length") > COLD) & (F.col("revision_count") > 1))
    out = flagged.select(key, "revision_count", "final_words", "bulk", few.alias("few"), cold.alias("cold"))
    return out.select("*", (F.col("bulk") + F.col("few") + F.col("cold")).alias("flag_count"), F.when(F.col("bulk") > 0, "high").when((F.col("few") > 0) | (F.col("cold") > 0), "medium").otherwise("none").alias("max_severity"))


def flags(revisions: DataFrame, key: str, deadline: str | None = None) -> DataFrame:
    """All flags of each document, one row each.

    ``revisions``: key, rev_no (from 1), modified_time (ISO text), added and
    first (characters that the revision added, and their first run), length
    and words (of the whole text), and ``deadline`` (ISO text) if named.
    Returns key, flag_no, flag_type, severity, description, snippet: what was
    inserted in bulk first, in the order of revisions, then the rest in the
    order of ``SEVERITY``.

    A time that can't be read leaves out the flags that need times.  All is
    told within one partitioning by key."""
    whole = Window.partitionBy(key).orderBy("rev_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = parse_time(F.col("modified_time")).cast("double")
    rows = revisions.select(
        key,
        "rev_no",
        "added",
        F.nullif("first", F.lit("")).alias("first"),
        at.alias("at"),
        F.hour(wall_clock(F.col("modified_time"))).alias("hour"),
        (parse_time(F.col(deadline)).cast("double") if deadline else F.lit(None).cast("double")).alias("deadline"),
        F.last("length").over(whole).alias("final_length"),
        F.last("words").over(whole).alias("final_words"),
        F.first("length").over(whole).alias("first_length"),
    )
    near = Window.partitionBy(key).orderBy("at").rangeBetween(0, BURST_MINUTES * 60)
    rows = rows.withColumn("in_window", F.sum("added").over(near)).withColumn("window_first", F.first("first", True).over(near))
    share = lambda n: F.when(F.col("final_length") > 0, n / F.col("final_length"))
    percent = lambda n: F.bround(share(n) * 100).cast("long")
    shown = lambda c: T.truncate(T.redact_pii(F.coalesce(c, F.lit(""))), SNIPPET)

    def flag(kind, snippet, *values):
        return F.struct(F.lit(kind).alias("flag_type"), F.lit(SEVERITY[kind]).alias("severity"), F.format_string(DESCRIPTIONS[kind], *values).alias("description"), snippet.alias("snippet"))

    bulk = F.when(share(F.col("added")) > BULK, F.struct("rev_no", flag("bulk_insertion", shown(F.col("first")), F.col("rev_no"), F.col("added"), percent(F.col("added"))).alias("f")))
    burst = F.when(share(F.col("in_window")) > BURST, flag("burst_editing", shown(F.col("window_first")), percent(F.col("in_window"))))
    left = F.col("deadline") - F.col("at")
    ends = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(bulk)).alias("bulk"),
        F.min_by(burst, F.when(burst.isNotNull(), F.struct("at", "rev_no"))).alias("burst"),
        F.min_by("first", "rev_no").alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.every(F.col("at").isNotNull()).alias("timed"),
        F.every((F.col("hour") < DAY_START) | (F.col("hour") >= DAY_END)).alias("off"),
        F.every(F.coalesce(left.between(0, DEADLINE_HOURS * 3600), F.lit(False))).alias("late"),
        *[F.first(c).alias(c) for c in ("final_length", "final_words", "first_length")],
    )
    n, blank = F.col("n"), F.lit("")
    told = F.array(
        F.when((F.col("final_words") >= FEW_WORDS) & (n <= FEW_REVISIONS), flag("few_revisions", blank, F.col("final_words"), n)),
        F.when(F.col("timed") & (n >= 2), F.col("burst")),
        F.when((share(F.col("first_length")) > COLD) & (n > 1), flag("cold_start", shown(F.col("first")), percent(F.col("first_length")))),
        F.when(F.col("timed") & F.col("off") & (n > 1), flag("timing_off_hours", blank, n)),
        F.when(F.col("timed") & F.col("late"), flag("deadline_crunch", blank)),
    )
    every = F.concat(F.transform("bulk", lambda b: b["f"]), F.array_compact(told))
    return ends.select(key, F.posexplode(every).alias("flag_no", "f")).select(key, (F.col("flag_no") + 1).cast("long").alias("flag_no"), "f.*")


def severity_rank(severity) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def label(index) -> Column:
    """``Submission A`` to ``Submission Z``, then by number from 27."""
    return F.concat(F.lit("Submission "), F.when(index < 26, F.char(65 + index)).otherwise((index + 1).cast("string")))


def report(flags: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """Labels by key order and triage order (severity, flags, both falling;
    ties keep label order) within each group of submissions.  Without a group
    all submissions are one, as those of a single assignment are."""
    by = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    placed = flags.withColumn("_i", F.row_number().over(by.orderBy(key)) - 1)
    order = by.orderBy(severity_rank(F.col("max_severity")).desc(), F.col("flag_count").desc(), F.col("_i"))
    return placed.withColumn("label", label(F.col("_i"))).withColumn("triage_rank", F.row_number().over(order).cast("long")).drop("_i")


def severity_counts(flags: DataFrame, by: list[str], severity: str = "severity") -> DataFrame:
    """Flags of each severity; what is neither high nor medium counts as low."""
    return flags.groupBy(*by).agg(
        F.count_if(F.col(severity) == "high").alias("high"),
        F.count_if(F.col(severity) == "medium").alias("medium"),
        F.count_if(F.coalesce(~F.col(severity).isin("high", "medium"), F.lit(True))).alias("low"),
    )


def keep_disjoint(intervals) -> Column:
    """Intervals (structs with start and end) in order of start, each kept if
    it starts no earlier than the last kept one ends."""
    empty = F.slice(intervals, 1, 0)
    return F.aggregate(F.array_sort(intervals), empty, lambda kept, i: F.when((F.size(kept) == 0) | (i["start"] >= F.coalesce(F.element_at(kept, -1)["end"], i["start"])), F.concat(kept, F.array(i))).otherwise(kept))
