"""Histogram sort into shards of near-equal bytes.

Rows are ordered by a 63-bit hash of their text, then by doc_id, so equal
texts stand together.  Exact bytes below candidate boundaries are counted over
all partitions; the counts narrow each boundary's range and yield the next
probes, until every boundary meets its tolerance.  Rows move once, at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Probes between two known boundaries in each round.
PROBES = 128
#: Of a shard's bytes: how far a boundary may lie from its place.
TOLERANCE = 0.005
#: Rows that one task sorts in the end, and the most such tasks per shard.
PIECE_ROWS, MOST_PIECES = 8192, 512

_PARTIAL = "range long, bin long, bytes long, rows long, lo long, hi long"


def _histogram(sized: DataFrame, ranges: list[tuple]) -> pd.DataFrame:
    """Bytes, rows, lowest and highest key per bin of each range.

    A range is (h, lo, hi): with h None the hashes lo..hi, else the ids
    lo..hi of hash h.  What the driver gets is bounded by ranges x PROBES.
    """

    wide = sorted((lo, hi, r) for r, (hash_, lo, hi) in enumerate(ranges) if hash_ is None)  # they don't overlap
    los, his, names = (np.array([x[i] for x in wide], np.int64) for i in range(3))
    widths = np.array([(hi - lo) // PROBES + 1 for lo, hi, _ in wide], np.int64)
    inner = [(r, *x) for r, x in enumerate(ranges) if x[0] is not None]

    def summed(r, bins, key, size):
        by = pd.DataFrame({"range": r, "bin": bins, "bytes": size, "rows": 1, "key": key}).groupby(["range", "bin"], as_index=False)
        return by.agg(bytes=("bytes", "sum"), rows=("rows", "sum"), lo=("key", "min"), hi=("key", "max"))

    def count(batches):
        for pdf in batches:
            h, d, size = (pdf[c].to_numpy() for c in ("h", "d", "size"))
            if len(los):
                r = np.searchsorted(los, h, "right") - 1
                inside = (r >= 0) & (h <= his[np.maximum(r, 0)])
                r, key = r[inside], h[inside]
                yield summed(names[r], (key - los[r]) // widths[r], key, size[inside])
            for r, hash_, lo, hi in inner:
                inside = (h == hash_) & (d >= lo) & (d <= hi)
                if inside.any():
                    key = d[inside]
                    bins = np.floor((key.astype(np.float64) - float(lo)) / ((hi - lo) // PROBES + 1)).astype(np.int64)
                    yield summed(r, bins, key, size[inside])

    part = sized.select("h", "d", "size").mapInPandas(count, _PARTIAL)
    return (
        part.groupBy("range", "bin")
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .toPandas()
        .sort_values(["range", "bin"])
    )


def splitters(sized: DataFrame, targets: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """For each (place in bytes, tolerance): the last key (hash, id) before it.

    A boundary falls between two hashes if one lies within the tolerance; a
    group of equal texts is cut, between two ids, only if it is larger.  If no
    key does (one long row, or rows that repeat an id), the nearest one is
    taken.
    """
    found: dict[int, tuple[int, int]] = {}
    # per open target: range, and bytes before it
    state = {t: ((None, 0, 2**63 - 1), 0) for t in range(len(targets))}
    while state:
        ranges = list(dict.fromkeys(r for r, _ in state.values()))
        index = {r: i for i, r in enumerate(ranges)}
        hist = {r: g for r, g in _histogram(sized, ranges).groupby("range")}
        for t, (rng, before) in list(state.items()):
            g = hist[index[rng]]
            place, tolerance = targets[t]
            ends = before + g["bytes"].cumsum().to_numpy()
            starts = ends - g["bytes"].to_numpy()
            hash_ = rng[0]
            as_key = lambda k: (int(k), 2**63 - 1) if hash_ is None else (hash_, int(k))  # noqa: B023, E731
            below = (rng[1] - 1, 2**63 - 1) if hash_ is None else (hash_, rng[1] - 1) if rng[1] > -(2**63) else (hash_ - 1, 2**63 - 1)
            cuts = [(abs(before - place), below), *((abs(int(e) - place), as_key(k)) for e, k in zip(ends, g["hi"], strict=True))]
            off, key = min(cuts)
            i = min(int(np.searchsorted(ends, place, "left")), len(g) - 1)
            lo, hi = int(g["lo"].iloc[i]), int(g["hi"].iloc[i])
            if off <= tolerance or (lo == hi and (hash_ is not None or int(g["rows"].iloc[i]) == 1)):
                found[t] = key
                del state[t]
            elif lo == hi:  # one group of equal texts: its ids
                state[t] = ((lo, -(2**63), 2**63 - 1), int(starts[i]))
            else:
                state[t] = ((hash_, lo, hi), int(starts[i]))
    return [found[t] for t in range(len(targets))]


def shard_by_bytes(documents: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """Each row with its shard and its slot there.

    Size of a row: UTF-8 bytes of ``text`` (null: none) plus 1.  Returns
    doc_id, size, text_crc32, shard (from 0), slot (gapless from 0 in each
    shard, in the order of hash and doc_id).  Shards have near-equal bytes:
    each boundary lies within ``tolerance`` of a shard's bytes from its place,
    or is the nearest that rows allow.

    Null text is like empty text, a null doc_id comes first, repeated rows
    each get a slot, an empty table gives an empty one, columns beside doc_id
    and text are ignored.
    """
    scratch = Scratch(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    sized = scratch.save(
        documents.select(
            "doc_id",
            F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("d"),
            F.shiftrightunsigned(F.xxhash64(text), 1).alias("h"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
    )
    rows, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    pieces = min(MOST_PIECES, max(1, -(-rows // (PIECE_ROWS * shards))))
    m = shards * pieces
    share = total / shards
    targets = [(round(total * i / m), round(share * tolerance) if i % pieces == 0 else round(share / pieces / 4)) for i in range(1, m)]
    cuts = splitters(sized, targets, total) if rows else []
    cut_h = np.array([h for h, _ in cuts], np.int64)
    cut_d = np.array([d for _, d in cuts], np.int64)

    def place(batches):
        for pdf in batches:
            h, d = pdf["h"].to_numpy(), pdf["d"].to_numpy()
            # cuts are few and ascending: those of a smaller hash, and of those of an equal hash the smaller ids
            piece = np.searchsorted(cut_h, h, "left")
            last = np.searchsorted(cut_h, h, "right")
            while (open_ := (piece < last) & (cut_d[np.minimum(piece, len(cut_d) - 1)] < d) if len(cut_d) else np.zeros(len(h), bool)).any():
                piece[open_] += 1
            yield pdf.assign(piece=piece)

    placed = scratch.save(sized.mapInPandas(place, "doc_id long, d long, h long, size long, text_crc32 long, piece long"))
    # rows before each piece in its shard: one number per piece
    counts = {r["piece"]: r["count"] for r in placed.groupBy("piece").count().collect()}
    offsets, at = [], 0
    for p in range(m):
        at = 0 if p % pieces == 0 else at
        offsets.append(at)
        at += counts.get(p, 0)
    first = F.element_at(F.lit(offsets) if offsets else F.array(F.lit(0)), (F.col("piece") + 1).cast("int"))
    w = Window.partitionBy("piece").orderBy("h", "d", "text_crc32", "size")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.floor(F.col("piece") / pieces).cast("int").alias("shard"),
        (first + F.row_number().over(w) - 1).cast("long").alias("slot"),
    )
