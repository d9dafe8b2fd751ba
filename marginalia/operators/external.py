"""Where services plug in: models, mail, remote drives.

Each is a function from a partition's rows to results, given to
``mapInPandas``; the stubs are deterministic."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TextModel(Protocol):
    def __call__(self, prompt: str) -> str: ...


class Transport(Protocol):
    def __call__(self, address: str, subject: str, body: str) -> None: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Recogniser(Protocol):
    def __call__(self, image: bytes) -> str: ...


def stub_model(prompt: str) -> str:
    return '{"overall_score": "%d"}' % (int(hashlib.sha256(prompt.encode()).hexdigest(), 16) % 101)


def stub_embedder(texts: list[str], size: int = 8) -> list[list[float]]:
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:size]] for t in texts]


def with_retry(call: Callable, tries: int = 3, most_seconds: float = 10, wait: Callable[[float], None] = time.sleep):
    """``call`` again after 1, 2, ... seconds, ``tries`` times in all."""

    def run(*args):
        for n in range(tries):
            try:
                return call(*args)
            except Exception:
                if n == tries - 1:
                    raise
                wait(min(most_seconds, 2**n))

    return run


def _with(rows: DataFrame, out: str, kind: str):
    """Schema of ``rows`` with one more column."""
    return rows.limit(0).withColumn(out, F.lit(None).cast(kind)).schema


def complete(rows: DataFrame, prompt: str, out: str, model: TextModel = stub_model) -> DataFrame:
    """``rows`` with the model's answer to a column of prompts."""

    def run(batches: Iterator[pd.DataFrame]):
        ask = with_retry(model)
        for pdf in batches:
            yield pdf.assign(**{out: [ask(p) if isinstance(p, str) else None for p in pdf[prompt]]})

    return rows.mapInPandas(run, _with(rows, out, "string"))


def embed(rows: DataFrame, text: str, out: str = "embedding", embedder: Embedder = stub_embedder) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{out: embedder(pdf[text].fillna("").tolist())})

    return rows.mapInPandas(run, _with(rows, out, "array<double>"))


def recognise(images: DataFrame, content: str, out: str, recogniser: Recogniser) -> DataFrame:
    """OCR of a binary column."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{out: [recogniser(bytes(c)) for c in pdf[content]]})

    return images.mapInPandas(run, _with(images, out, "string"))


def send(ready: DataFrame, transport: Transport, dry_run: bool = False) -> DataFrame:
    """Log rows of sending (student_name, email, subject, body): SENT, FAILED
    with a reason, or DRY_RUN.  Write the result once; it sends as it runs."""

    def run(batches):
        for pdf in batches:
            log = []
            for r in pdf.itertuples():
                status, reason = "DRY_RUN", None
                if not dry_run:
                    try:
                        transport(r.email, r.subject, r.body)
                        status = "SENT"
                    except Exception as e:
                        status, reason = "FAILED", str(e)
                log.append((r.student_name, r.email, r.subject, status, reason))
            yield pd.DataFrame(log, columns=["student_name", "email_address", "subject", "status", "reason"])

    return ready.mapInPandas(run, "student_name string, email_address string, subject string, status string, reason string")


def needs_ocr(pages: DataFrame, least: float = 10) -> DataFrame:
    """Files whose pages have fewer than ``least`` characters on average."""
    return pages.groupBy("file").agg(F.avg(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("mean_chars")).withColumn("needs_ocr", F.col("mean_chars") < least)


def called(rows: DataFrame, column: str, out: str, kind: str, service: Callable, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows`` with what a service makes of a column, with retries: pages of
    a PDF as images, a file in another format, the markers of a scan, the
    questions of a source.  Null stays null; a call that fails for good gives
    null and its reason in ``<out>_error``."""
    schema = rows.limit(0).withColumn(out, F.lit(None).cast(kind)).withColumn(f"{out}_error", F.lit(None).cast("string")).schema

    def run(batches):
        ask = with_retry(service, tries, wait=wait)
        for pdf in batches:
            made, why = [], []
            for v in pdf[column].tolist():
                result, reason = None, None
                if v is not None and v == v:
                    try:
                        result = ask(bytes(v) if isinstance(v, (bytearray, memoryview)) else v)
                    except Exception as e:
                        reason = f"{type(e).__name__}: {e}"
                made.append(result)
                why.append(reason)
            yield pdf.assign(**{out: pd.Series(made, index=pdf.index, dtype=object), f"{out}_error": pd.Series(why, index=pdf.index, dtype=object)})

    return rows.mapInPandas(run, schema)


def paged(parents: DataFrame, key: str, fetch: Callable[[object, str | None], tuple[list[dict], str | None]], schema: str, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Rows of a remote listing for each parent, page after page.

    ``fetch(parent, token)`` gives a page's rows and the token of the next
    page, none after the last.  Each row has the parent's ``key`` too.  Pages
    are fetched where the parent lies and passed on one at a time."""
    kind = parents.schema[key].dataType.simpleString()

    def run(batches):
        ask = with_retry(fetch, wait=wait)
        for pdf in batches:
            for parent in pdf[key].tolist():
                token, more = None, True
                while more:
                    rows, token = ask(parent, token)
                    more = token is not None
                    if rows:
                        yield pd.DataFrame(rows).assign(**{key: parent})

    return parents.select(key).distinct().mapInPandas(run, f"{key} {kind}, {schema}")


LEDGER = "job_id string, report_type string, student_name string, email_address string, status string, reason string, subject string, sent_at timestamp, batch string"


def ledger(spark, path: str) -> DataFrame:
    """The log of all attempts; empty before the first one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def run_campaign(ready: DataFrame, path: str, job_id: str, report_type: str, at: str, transport: Transport, dry_run: bool = False) -> DataFrame:
    """Send to the ``ready`` students (student_name, email, subject, body) of a
    campaign and append every attempt to the ledger at ``path``; returns this
    call's rows of it.

    Who has a row with ``SENT`` for the job and the report gets nothing, so a
    call may be repeated.  ``at`` names the call: it is the time in its rows."""
    spark = ready.sparkSession
    sent = ledger(spark, path).where((F.col("job_id") == job_id) & (F.col("report_type") == report_type) & (F.col("status") == "SENT"))
    todo = ready.dropDuplicates(["student_name"]).join(sent.select("student_name").distinct(), "student_name", "left_anti")
    batch = hashlib.sha256(f"{job_id}|{report_type}|{at}|{time.time_ns()}".encode()).hexdigest()[:16]
    rows = send(todo.select("student_name", "email", "subject", "body"), transport, dry_run)
    rows = rows.select(F.lit(job_id).alias("job_id"), F.lit(report_type).alias("report_type"), "student_name", "email_address", "status", "reason", "subject", F.lit(at).cast("timestamp").alias("sent_at"), F.lit(batch).alias("batch"))
    rows.write.mode("append").parquet(path)
    return ledger(spark, path).where(F.col("batch") == batch)
