"""Pages to documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

UNKNOWN = "Unknown Student"


def sessionise(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Documents of each file: a detected name starts one, unnamed pages go on
    with it, and leading unnamed ones are ``Unknown Student NN``.

    ``pages``: file, page_no, text, detected_name.  Returns file, document
    (from 1), student_name, text, start_page, end_page, page_count."""
    w = Window.partitionBy("file").orderBy("page_no")
    starts = F.when(F.col("detected_name").isNotNull() & (F.col("detected_name") != ""), 1).otherwise(0)
    marked = pages.withColumn("island", F.sum(starts).over(w))
    grouped = marked.groupBy("file", "island").agg(
        F.min_by("detected_name", "page_no").alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.trim("text").alias("t")))), lambda s: s["t"]), separator).alias("text"),
        F.min("page_no").alias("start_page"),
        F.max("page_no").alias("end_page"),
    )
    by = Window.partitionBy("file").orderBy("island")
    return grouped.select(
        "file",
        F.row_number().over(by).cast("long").alias("document"),
        F.when(F.col("island") == 0, f"{UNKNOWN} 01").otherwise(F.col("name")).alias("student_name"),
        "text",
        "start_page",
        "end_page",
        (F.col("end_page") - F.col("start_page") + 1).alias("page_count"),
    )


def sessionise_routed(pages: DataFrame, separator: str = "\f") -> DataFrame:
    """As ``sessionise``, but a page that continues a named document goes to
    it and leaves the open one as it is.

    It goes to the last document of that name, else to the next to come, after
    whose first page it stands; without either, the pages that continue one
    name are a document at the file's end.  A page that continues without a
    name is an unknown document of its own, before the one that is open.
    Documents are in the order in which they end; names are compared by lower
    case with white space collapsed."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    in_file = Window.partitionBy("file").orderBy("page_no")
    base = pages.select(
        F.col("file").cast("string").alias("file"),
        F.col("page_no").cast("int").alias("page_no"),
        F.trim(F.coalesce("text", F.lit(""))).alias("text"),
        "detected_name",
        "continuation_name",
        (F.coalesce("continuation_name", F.lit("")) != "").alias("goes_on"),
        (F.coalesce("detected_name", F.lit("")) != "").alias("named"),
        T.normal_name(filled("continuation_name")).alias("wanted"),
    )
    # a document starts at a name, or at the first page that neither continues nor is named
    before = F.count_if(~F.col("goes_on")).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    opened = base.withColumn("starts", ~F.col("goes_on") & (F.col("named") | (F.coalesce(before, F.lit(0)) == 0)))
    opened = opened.withColumn("key", F.when(F.col("goes_on"), F.col("wanted")).when(F.col("starts") & F.col("named"), T.normal_name(filled("detected_name"))).otherwise(""))
    start = F.when(F.col("starts"), F.col("page_no"))
    of_name = Window.partitionBy("file", "key").orderBy("page_no")
    last = F.last(start, True).over(of_name.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.first(start, True).over(of_name.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    routed = opened.withColumn("home", F.when(F.col("goes_on") & (F.col("key") != ""), F.coalesce(last, following)))
    routed = routed.withColumn("open_from", F.last(start, True).over(in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    routed = routed.withColumn("next_start", F.min(start).over(in_file.rowsBetween(1, Window.unboundedFollowing)))
    lone = F.col("goes_on") & (F.col("key") == "")
    orphan = F.col("goes_on") & (F.col("key") != "") & F.col("home").isNull()
    placed = routed.select(
        "file",
        "page_no",
        "text",
        "starts",
        F.when(orphan, "end").when(lone, "lone").otherwise("page").alias("kind"),
        F.when(orphan, F.col("key")).otherwise("").alias("orphan"),
        F.when(lone, F.col("page_no")).when(F.col("goes_on"), F.col("home")).otherwise(F.col("open_from")).alias("first"),
        F.when(orphan, F.col("continuation_name")).when(F.col("starts") & F.col("named"), F.col("detected_name")).alias("name"),
        F.when(lone, F.col("page_no")).when(F.col("starts"), F.coalesce("next_start", F.lit(2**31 - 1))).alias("ends"),
    )
    in_order = F.array_sort(F.collect_list(F.struct((~F.col("starts")).alias("later"), "page_no", "text")))
    documents = placed.groupBy("file", "kind", "orphan", "first").agg(
        F.array_join(F.transform(in_order, lambda p: p["text"]), separator).alias("text"),
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("page_no"))).alias("name"),
        F.min("page_no").alias("start_page"),
        F.max("page_no").alias("end_page"),
        F.max("ends").alias("ends"),
    )
    unnamed = F.row_number().over(Window.partitionBy("file", F.col("name").isNull()).orderBy("start_page"))
    order = Window.partitionBy("file").orderBy(F.col("kind") == "end", F.coalesce("ends", F.col("start_page")), "start_page")
    return documents.select(
        "file",
        F.row_number().over(order).cast("long").alias("document"),
        F.coalesce("name", F.concat(F.lit(f"{UNKNOWN} "), F.lpad(unnamed.cast("string"), 2, "0"))).alias("student_name"),
        "text",
        "start_page",
        "end_page",
        (F.col("end_page") - F.col("start_page") + 1).alias("page_count"),
    )


def page_text(words: DataFrame) -> DataFrame:
    """Text of pages from words with positions (file, page_no, seq, word, top).

    A word within three points of its line's first word is on that line; a gap
    of one and a half upper medians or more starts a paragraph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines: list[tuple[float, list[str]]] = []
        for word, top in pdf.sort_values("seq")[["word", "top"]].itertuples(index=False):
            if lines and abs(top - lines[-1][0]) <= 3:
                lines[-1][1].append(word)
            else:
                lines.append((top, [word]))
        gaps = [b[0] - a[0] for a, b in zip(lines, lines[1:], strict=False)]
        wide = sorted(gaps)[len(gaps) // 2] * 1.5 if gaps else 0
        text = " ".join(lines[0][1]) + "".join(("\n\n" if g >= wide else "\n") + " ".join(ws) for g, (_, ws) in zip(gaps, lines[1:], strict=True))
        return pd.DataFrame({"file": pdf["file"].iloc[:1].astype(str), "page_no": pdf["page_no"].iloc[:1], "text": [text]})

    return words.groupBy("file", "page_no").applyInPandas(run, "file string, page_no int, text string")
