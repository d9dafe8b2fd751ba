"""Shared pieces: scratch tables in the cluster's checkpoint folder, an
order-independent connected-components routine, and text coercion.

Scratch tables are ordinary Parquet folders below ``spark.checkpoint.dir`` so
that they cut lineage and survive the loss of any executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``, or a folder
    of the warehouse where the session names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Written tables of one operator call.

    ``save`` writes and rereads a table; ``drop`` removes those that nothing
    returned depends on any more.  What a returned table still reads goes when
    the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        if self._n == 1:
            self._file_system(self.root).deleteOnExit(self._path(self.root))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _file_system(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def delete(self, path: str) -> None:
        self._file_system(path).delete(self._path(path), True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.delete(t._scratch_path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns ``a``, ``b``).

    The component is the smallest node of it.  Labels travel along edges and
    then jump through their own label, so long chains shrink geometrically.
    Minima are pre-aggregated before each shuffle; the joins read written
    tables on both sides so that adaptive execution can split a hot node.
    Null ends are ignored; repeated edges and self-loops change nothing.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = scratch.save(e.union(e.select(F.col("b"), F.col("a"))).distinct())
    loops = edges.where("a is not null").select(F.col("a").alias("node"), F.col("a").alias("l")).union(
        edges.where("b is not null").select(F.col("b"), F.col("b"))
    )
    first = both.select(F.col("a").alias("node"), F.col("b").alias("l")).union(loops)
    labels = scratch.save(first.groupBy("node").agg(F.min("l").alias("l")).select("node", F.least("node", "l").alias("label")))
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("m"))
        )
        low = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = scratch.save(low.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("top", "label")).alias("label")))
        done = new.where("was <> label").limit(1).count() == 0
        scratch.drop(labels)
        labels = new
        if done:
            scratch.drop(both)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, or until another name
    is asked for: a worker holds one operator's data at a time."""
    import sys
    import types

    home = sys.modules.setdefault("_marginalia_worker", types.ModuleType("_marginalia_worker"))
    held = home.__dict__.setdefault("held", {})
    for other in [n for n in held if n != name]:
        del held[other]
    return held.setdefault(name, {})
