"""File sources and sinks of the engine.

Paths go through Spark's readers, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Every driver table as a temporary view."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Roster CSV with a header: all strings, and ``position`` by file and
    line: files by name, lines as they are read."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    wanted = ("id", "first_name", "last_name", "grade", "email")
    have = {c.strip().lower(): c for c in raw.columns}
    return raw.select(*[(F.col(have[c]) if c in have else F.lit(None)).cast("string").alias(c) for c in wanted], F.monotonically_increasing_id().alias("position"))


def read_texts(spark: SparkSession, folder: str, glob: str = "*.txt") -> tuple[DataFrame, DataFrame]:
    """Essays of a folder (student_identifier from the file's stem, text), and
    the blank files."""
    files = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    named = files.select(F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.[^.]*$", "").alias("student_identifier"), F.col("value").alias("text"))
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    return named.where(~blank), named.where(blank).select("student_identifier")


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def discover(spark: SparkSession, folders: list[str], extensions=("pdf",)) -> tuple[DataFrame, list[str]]:
    """Files of several folders and all below them, and the folders that are
    missing: these are told, not raised."""
    found = [f for f in folders if _there(spark, f)]
    missing = [f for f in folders if f not in found]
    if not found:
        return spark.createDataFrame([], "path string, length long, content binary"), missing
    return read_binaries(spark, found, extensions, recursive=True), missing


def each_file(files: DataFrame, read, out: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """What ``read`` makes of each file's content, and the files it fails on
    with the reason: one bad file stops no other."""
    from ..operators.external import called

    rows = called(files, "content", out, kind, read, tries=1).drop("content")
    return rows.where(F.col(f"{out}_error").isNull()).drop(f"{out}_error"), rows.where(F.col(f"{out}_error").isNotNull()).select("path", F.col(f"{out}_error").alias("reason"))


def read_binaries(spark: SparkSession, folder: str | list[str], extensions=("pdf",), recursive: bool = False) -> DataFrame:
    """Files by extension in any case: path, length, content."""
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(folder).select("path", "length", "content")


def read_skip_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a JSON array file, one row each; one that is missing or no JSON
    array is empty."""
    if not _there(spark, path):
        return spark.createDataFrame([], "name string")
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "array<string>")).alias("name"))


def write_gradebook(df: DataFrame, path: str) -> None:
    """One CSV file with a header; a gradebook is one job's report."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def fetch_base64(df: DataFrame, content: str = "content") -> DataFrame:
    """Stored artifacts as base64 with their size."""
    return df.withColumn("size", F.length(content)).withColumn("base64", F.base64(content)).drop(content)


def safe_filename(name):
    return T.safe_name(name)
