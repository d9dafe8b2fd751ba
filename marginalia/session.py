"""Session settings that the engine is meant to run with."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(master: str | None = None, **conf) -> SparkSession:
    """A session with ``SETTINGS``; ``conf`` adds to or replaces them."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k: str(v) for k, v in conf.items()}).getOrCreate()
