"""Streaming forms of the windowed operators (an extension: the batch forms
define the results)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_totals(events: DataFrame, key: str, ts: str = "ts", value: str = "value", size: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Totals of each key in sliding windows; late rows within ``late``."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide), key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))


def once(log: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark: an idempotency ledger."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def deliver(ready: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch to ``sink``, exactly once if it is idempotent by
    batch id."""
    return ready.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
