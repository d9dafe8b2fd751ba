"""Replacing names in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_EDGE = r"[\p{L}\p{M}\p{N}_]"


def _pattern(names) -> Column:
    """Any of the names as whole words, the longest where several fit."""
    quoted = F.transform(F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))), lambda s: F.concat(F.lit(r"\Q"), s["n"], F.lit(r"\E")))
    return F.concat(F.lit(f"(?iu)(?<!{_EDGE})(?:"), F.array_join(quoted, "|"), F.lit(f")(?!{_EDGE})"))


def scrub(documents: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", own: str | None = None, custom: list[str] = ()) -> DataFrame:
    """``documents`` with ``scrubbed``: every whole-word occurrence of a name
    of the dictionary ``names`` (column name), of a part of the document's
    ``own`` name or of a ``custom`` word becomes a placeholder, in any case
    and script.

    Names may have several words, hyphens and apostrophes; of names that start
    at one place the longest goes.  A name that begins or ends with a sign
    that no word has needs no border there.  Scrubbing again changes nothing.

    A dictionary of any size is joined by the first word of its names to the
    distinct words of each document, so neither texts nor dictionary meet in
    one task; each text is then searched for its own candidates alone."""
    first = lambda c: F.regexp_extract(c, T.WORD, 0)
    known = names.select(F.lower(F.trim("name")).alias("_name")).distinct().withColumn("_word", first(F.col("_name"))).where("_word <> ''")
    words = documents.select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(T.WORD), F.lit(0)))).alias("_word")).distinct()
    hits = words.join(known, "_word").groupBy("_key").agg(F.collect_set("_name").alias("_hits"))
    joined = documents.join(hits, F.col(key).eqNullSafe(F.col("_key")), "left")
    empty = F.array().cast("array<string>")
    wanted = F.array_union(F.coalesce("_hits", empty), F.array(*[F.lit(w.strip().lower()) for w in custom if w.strip()]).cast("array<string>"))
    if own:
        wanted = F.array_union(wanted, F.coalesce(T.name_parts(own), empty))
    out = joined.withColumn("_wanted", wanted)
    scrubbed = F.when(F.size("_wanted") > 0, F.regexp_replace(F.col(text), _pattern(F.col("_wanted")), F.lit(T.PLACEHOLDER))).otherwise(F.col(text))
    return out.withColumn("scrubbed", scrubbed).select(*documents.columns, "scrubbed")


def restore(text, name):
    """The placeholder back to the real name."""
    return F.replace(text, F.lit(T.PLACEHOLDER), name)
