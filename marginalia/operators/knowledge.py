"""Vector retrieval and chunking."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK_WORDS, OVERLAP = 512, 50
#: Query vectors that are sent to every partition at once.
BLOCK_QUERIES = 2_000


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest vectors of each query by cosine; ties to the smaller
    vec_id.  ``queries``: query_id, query; ``vectors``: vec_id, embedding.

    Queries are asked in blocks of ``BLOCK_QUERIES``, which go to where the
    vectors lie: a batch of vectors meets a block in one matrix product, and
    each batch's best ``k`` of a query are all that moves.  Vectors without a
    length, null ones and those of another length than the query have no
    similarity and are never near."""
    spark = queries.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")).where("query is not null")
    blocks = -(-asked.count() // BLOCK_QUERIES)
    found = []
    for block in range(blocks):
        # a block has BLOCK_QUERIES vectors at about, and so is of bounded size
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        by_size: dict[int, list] = {}
        for r in mine:
            by_size.setdefault(len(r["query"]), []).append((r["query_id"], r["query"]))
        shared = spark.sparkContext.broadcast({n: (np.array([i for i, _ in rs], np.int64), np.array([q for _, q in rs], float)) for n, rs in by_size.items()})

        def nearest(batches, shared=shared):
            for pdf in batches:
                pdf = pdf[pdf["embedding"].notna()]
                sizes = pdf["embedding"].str.len()
                for n, (ids, q) in shared.value.items():
                    part = pdf[sizes == n]
                    if not len(part):
                        continue
                    v, vec = np.stack(part["embedding"].to_numpy()).astype(float), part["vec_id"].to_numpy(np.int64)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        sim = (q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :])
                    sim = np.where(np.isnan(sim), -np.inf, sim)
                    order = np.lexsort((np.broadcast_to(vec, sim.shape), -sim), axis=1)[:, :k]
                    best = np.take_along_axis(sim, order, axis=1)
                    out = pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "vec_id": vec[order].ravel(), "similarity": best.ravel()})
                    yield out[np.isfinite(out["similarity"])]

        held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
        found.append(held.mapInPandas(nearest, "query_id long, vec_id long, similarity double"))
    if not found:
        return spark.createDataFrame([], "query_id long, vec_id long, similarity double, rank long")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def chunks(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` words that overlap; the last may be shorter.  A
    text without words has none."""
    split = documents.select(key, T.words(text).alias("w")).where(F.size("w") > 0)
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int")
    # each row carries its own words alone
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i * step + 1, F.lit(size)))
    rows = split.select(key, F.posexplode(parts).alias("chunk", "part"))
    return rows.select(key, F.col("chunk").cast("long").alias("chunk"), F.size("part").cast("long").alias("n_words"), F.array_join("part", " ").alias("chunk_text"))
