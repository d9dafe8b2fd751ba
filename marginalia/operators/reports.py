"""Report text of rows: gradebook names, annotated HTML, archives."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Only essays in these states are packaged.
PACKAGED = ("GRADED", "REVIEWED", "APPROVED")


def identify(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Real names by an identity map (key, student_name); else the key."""
    return rows.join(names.select(key, F.col("student_name").alias("_real")), key, "left").withColumn("student_name", F.coalesce(T.first_filled("_real"), key)).drop("_real")


def annotated(text: Column, spans: Column) -> Column:
    """Escaped text with disjoint ascending spans (start, end, comment)."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    piece = lambda a, b: T.escape_html(F.substring(text, a + 1, b - a))
    done = F.aggregate(
        spans,
        start,
        lambda s, i: F.struct(
            F.concat(s["out"], piece(s["at"], i["start"]), F.lit('<span class="annotation" title="'), T.escape_html(i["comment"]), F.lit('">'), piece(i["start"], i["end"]), F.lit("</span>")).alias("out"),
            i["end"].cast("int").alias("at"),
        ),
    )
    return F.concat(done["out"], T.escape_html(F.substring(text, done["at"] + 1, F.length(text))))


def student_report(title: Column, grade: Column, body: Column, notes: Column) -> Column:
    """A page of HTML for one essay."""
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"),
        T.escape_html(title),
        F.lit("</title></head><body><h1>"),
        T.escape_html(title),
        F.lit("</h1><p class='grade'>"),
        T.escape_html(F.coalesce(grade, F.lit(""))),
        F.lit("</p>"),
        body,
        F.lit("<section class='notes'>"),
        T.html_paragraphs(F.coalesce(notes, F.lit(""))),
        F.lit("</section></body></html>"),
    )


def packaged(essays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Essays to package, and those that are skipped."""
    ready = F.coalesce(F.col("status").isin(*PACKAGED), F.lit(False))
    return essays.where(ready), essays.where(~ready)


def archive(rows: DataFrame, key: str, name: str, content: str) -> DataFrame:
    """One ZIP per key with a manifest: (key, archive).  A job's reports meet
    in one task, as they do in its archive."""

    def pack(pdf):
        import pandas as pd

        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            listed = []
            for n, c in sorted(zip(pdf[name], pdf[content], strict=True)):
                z.writestr(zipfile.ZipInfo(n), c)
                listed.append({"file": n, "bytes": len(c)})
            z.writestr(zipfile.ZipInfo("manifest.json"), json.dumps(listed))
        return pd.DataFrame({key: pdf[key].iloc[:1].astype(str), "archive": [buffer.getvalue()]})

    return rows.select(F.col(key).cast("string").alias(key), name, F.col(content).cast("binary").alias(content)).groupBy(key).applyInPandas(pack, f"{key} string, archive binary")
