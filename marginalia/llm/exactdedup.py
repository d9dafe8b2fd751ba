"""Exact deduplication of a batch against an immutable snapshot.

The snapshot's distinct digests are dealt into buckets, and each bucket gets a
static binary-fuse filter.  Incoming digests pass the filters first; only
positives join the snapshot's exact buckets, and members of a group are
compared byte by byte.  Digests that are new are grouped among themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: Keys for which one filter is built.
BUCKET_KEYS = 4096
#: Rows from which a group can be hot.
HOT_ROWS = 64

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: a 64-bit finaliser's multipliers


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    for m in (_M1, _M2):
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


class FuseFilter:
    """Binary-fuse filter with three places per key and 16-bit fingerprints;
    false-positive rate 2 ** -16, no false negatives."""

    def __init__(self, seed: int, seg_len: int, seg_count: int, table: np.ndarray):
        self.seed, self.seg_len, self.seg_count, self.table = seed, seg_len, seg_count, table

    @staticmethod
    def _places(h: np.ndarray, seg_len: int, seg_count: int) -> np.ndarray:
        first = (h >> np.uint64(32)) * np.uint64(seg_len * seg_count) >> np.uint64(32)
        low = np.uint64(seg_len - 1)
        second = (first + np.uint64(seg_len)) ^ ((h >> np.uint64(18)) & low)
        third = (first + np.uint64(2 * seg_len)) ^ (h & low)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = max(2, len(keys))
        seg_len = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
        room = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
        seg_count = max(1, -(-room // seg_len) - 2)
        for seed in range(1, 1000):
            if seed % 20 == 0:  # tiny sets can need more room
                seg_count += 1
            h = _mixed(keys, seed * 0x9E3779B97F4A7C15)
            at = cls._places(h, seg_len, seg_count)
            size = (seg_count + 2) * seg_len
            rounds, left = [], np.arange(len(keys))
            load = np.bincount(at.ravel(), minlength=size)
            while len(left):
                single = load[at[:, left]] == 1
                free = single.any(axis=0)
                if not free.any():
                    break
                peeled = left[free]
                rounds.append((peeled, np.argmax(single[:, free], axis=0)))
                load -= np.bincount(at[:, peeled].ravel(), minlength=size)
                left = left[~free]
            if len(left):
                continue
            table, fp = np.zeros(size, np.uint16), cls._prints(h)
            for peeled, own in reversed(rounds):
                places = at[:, peeled]
                target = places[own, np.arange(len(peeled))]
                table[target] = 0
                table[target] = fp[peeled] ^ table[places[0]] ^ table[places[1]] ^ table[places[2]]
            return cls(seed, seg_len, seg_count, table)
        raise ValueError("no filter found")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(keys.astype(np.uint64), self.seed * 0x9E3779B97F4A7C15)
        a, b, c = self._places(h, self.seg_len, self.seg_count)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == self._prints(h)


_FILTERS = "bucket long, seed long, seg_len long, seg_count long, body binary"


def build_filters(digests: DataFrame) -> DataFrame:
    """One filter row per bucket of ``digests`` (bucket, key)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "seed": f.seed, "seg_len": f.seg_len, "seg_count": f.seg_count, "body": [f.table.tobytes()]})

    return digests.groupBy("bucket").applyInPandas(build, _FILTERS)


def screen(digests: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of ``digests`` (bucket, key, digest) that a filter lets pass."""

    def passing(rows: pd.DataFrame, filt: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(filt):
            return rows.iloc[:0][["digest"]]
        f = filt.iloc[0]
        one = FuseFilter(int(f["seed"]), int(f["seg_len"]), int(f["seg_count"]), np.frombuffer(f["body"], np.uint16))
        return rows.loc[one.contains(rows["key"].to_numpy().view(np.uint64)), ["digest"]]

    return digests.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(passing, "digest string")


def groups_of(keys: DataFrame) -> DataFrame:
    """(digest, n, top, key): rows and largest doc_id of each digest."""
    return keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).withColumn("key", F.xxhash64("digest"))


def _keyed(docs: DataFrame, digest) -> DataFrame:
    norm = ascii_lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", norm.alias("norm")).withColumn("text_sha256", F.sha2("norm", 256)).withColumn("digest", digest(F.col("text_sha256")))


def _dealt(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.select(F.expr(f"pmod(key, {buckets}L)").alias("bucket"), "key", "digest")


def _build(groups: DataFrame, path: str) -> None:
    groups.write.option("compression", "zstd").parquet(f"{path}/groups")
    stored = groups.sparkSession.read.schema(groups.schema).parquet(f"{path}/groups")
    buckets = max(1, -(-stored.count() // BUCKET_KEYS))
    filters = build_filters(_dealt(stored, buckets).select("bucket", "key")).withColumn("buckets", F.lit(buckets).cast("long"))
    filters.write.option("compression", "zstd").parquet(f"{path}/filters")


def build(snapshot: DataFrame, path: str, digest: Callable[[Column], Column] | None = None) -> None:
    """Write a snapshot's groups and filters below ``path``, once; every later
    batch is screened against them (``load``)."""
    _build(groups_of(_keyed(snapshot, digest or (lambda sha: sha))), path)


def load(spark, path: str) -> tuple[DataFrame, DataFrame, int]:
    """Groups, filters and the number of buckets that ``build`` wrote."""
    filters = spark.read.schema(_FILTERS + ", buckets long").parquet(f"{path}/filters")
    first = filters.select("buckets").first()
    return spark.read.schema("digest string, n long, top long, key long").parquet(f"{path}/groups"), filters.drop("buckets"), first[0] if first else 1


def dedup(snapshot: DataFrame, batch: DataFrame, digest: Callable[[Column], Column] | None = None, built: str | None = None) -> DataFrame:
    """Groups of equal texts over an immutable snapshot and a new batch.

    Both have doc_id and text; other columns are ignored.  Texts are equal if
    identical after lower-casing A-Z; null counts as empty.  Returns a row for
    each row of either: doc_id, keep_id (largest doc_id of the group),
    group_size, kept, text_sha256, in_snapshot.  ``built`` is where ``build``
    wrote this snapshot's filters; without it they are built for this call.

    Rows are named by doc_id: repeated rows of the doc_id that stays are all
    kept.  A null doc_id stays only in a group without any other.  Empty
    tables give no rows.  ``digest`` maps the SHA-256 to a weaker digest, to
    test that bytes decide and not digests.

    Groups of more than a ten-thousandth of the rows (of ``HOT_ROWS`` at
    least), of which there can be ten thousand at most, are broadcast; their
    texts are compared in salted parts of that size.  The other joins grow
    with the rows and are merge joins at every size.
    """
    spark = snapshot.sparkSession
    scratch = Scratch(spark)
    digest = digest or (lambda sha: sha)
    docs = _keyed(snapshot.select("doc_id", "text"), digest).withColumn("old", F.lit(True)).unionByName(_keyed(batch.select("doc_id", "text"), digest).withColumn("old", F.lit(False)))
    keys = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "old", "text_sha256", "digest"))
    fresh = built is None
    if fresh:
        built = f"{scratch.root}/snapshot"
        _build(groups_of(keys.where("old")), built)
    old, filters, buckets = load(spark, built)
    new = scratch.save(groups_of(keys.where("not old")))
    known = screen(_dealt(new, buckets), filters)
    met = known.join(new.hint("merge"), "digest").join(old.select("digest", F.col("n").alias("n_old"), F.col("top").alias("top_old")).hint("merge"), "digest")
    met = scratch.save(met.select("digest", (F.col("n") + F.col("n_old")).alias("n"), F.greatest("top", "top_old").alias("top")))
    apart = old.unionByName(new).join(met.select("digest").hint("merge"), "digest", "left_anti").select("digest", "n", "top")
    classes = scratch.save(met.unionByName(apart))
    if fresh:
        scratch.delete(built)
    hot_rows = max(HOT_ROWS, keys.count() // 10_000)
    hot = F.broadcast(classes.where(F.col("n") > hot_rows))
    # byte checks: every member of a group against one of its members
    parts = F.ceil(F.col("n") / hot_rows).cast("int").alias("parts")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    several = classes.where("n > 1").select("digest", F.col("top").alias("ref_id"), parts)
    dealt = docs.join(hot.select("digest", parts), "digest", "left").withColumn("salt", F.coalesce(F.expr("pmod(xxhash64(doc_id), parts)"), F.lit(0)).cast("int")).drop("parts")
    members = scratch.save(dealt.join(salted(several).hint("merge"), ["digest", "salt"]).select("doc_id", "digest", "salt", "norm", "ref_id", "parts"))
    refs = members.where("doc_id <=> ref_id").groupBy("digest").agg(F.min("norm").alias("ref"), F.first("parts").alias("parts"))
    refs = scratch.save(refs)
    odd = scratch.save(members.join(salted(refs).hint("merge"), ["digest", "salt"]).where("norm <> ref").select("digest").distinct())
    scratch.drop(new, met, members, refs)
    cold = keys.join(hot.select("digest"), "digest", "left_anti").join(classes.where(F.col("n") <= hot_rows).hint("merge"), "digest")
    out = keys.join(hot, "digest").unionByName(cold)
    if odd.limit(1).count():  # digests that several texts share: their texts are the keys
        texts = docs.join(odd, "digest")
        exact = scratch.save(texts.groupBy("text_sha256", "norm").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")))
        split = texts.join(exact, ["text_sha256", "norm"]).select("digest", "doc_id", "old", "text_sha256", "n", "top")
        out = out.join(odd, "digest", "left_anti").select(split.columns).unionByName(split)
    return out.select(
        "doc_id", F.col("top").alias("keep_id"), F.col("n").cast("long").alias("group_size"), F.expr("doc_id <=> top").alias("kept"), "text_sha256", F.col("old").alias("in_snapshot")
    )


def dedup_table(documents: DataFrame) -> DataFrame:
    """``dedup`` of one table: half of it, by a hash of doc_id, is taken as
    the snapshot and the rest as the new batch.  Null ids go to the batch."""
    docs = documents.select("doc_id", "text")
    half = F.coalesce(F.expr("pmod(xxhash64(doc_id), 2L) = 0 and doc_id is not null"), F.lit(False))
    return dedup(docs.where(half), docs.where(~half))
