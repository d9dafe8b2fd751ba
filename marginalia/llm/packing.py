"""Hierarchical residual packing of token pieces into sequences.

Documents are tokenised where they lie.  Pieces are packed best-fit within
groups of bounded size; nearly full bins are final, and each group passes on
its underfull bin and its emptiest others.  Groups merge in a tree, whose
nodes take the bins passed on as items of another best-fit round.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, worker_cache

#: Items of one local round; bins that a node passes on; nodes that one node merges.
GROUP_ITEMS, PASSED, FAN_IN = 4096, 16, 16

class ByteBpe:
    """Token ids of a byte-level BPE vocabulary file of the ``tokenizers``
    library, as little-endian 32-bit bytes.

    The merges run in ``tiktoken``, which gives the same ids some five times
    as fast.
    """

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        chars = self._byte_chars()
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level pre-tokeniser's pattern
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def _byte_chars() -> dict[str, int]:
        """The vocabulary file writes each byte as a printable character."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def _raw(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if self.at_special and any(s in text for s in self.special):
            return b"".join(np.array([self.special[part]], "<u4").tobytes() if part in self.special else self.encode(part) for part in self.at_special.split(text) if part)
        return self._raw(text)


def tokenise(documents: DataFrame, vocabulary: str, length: int, end_id: int) -> DataFrame:
    """Pieces of at most ``length`` ids: uid, doc_id, piece, start, length,
    ids (little-endian 32-bit).  ``uid`` names the piece within this frame."""

    def run(batches):
        kept = worker_cache("byte_bpe")
        if vocabulary not in kept:
            kept[vocabulary] = ByteBpe(vocabulary)
        bpe = kept[vocabulary]
        end, uid = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                rows = []
                for doc_id, text in zip(pdf["doc_id"].iloc[at : at + 512], pdf["text"].iloc[at : at + 512], strict=True):
                    ids = bpe.encode(text) + end
                    n = len(ids) // 4
                    cuts = [0, *range(n % length or length, n + 1, length)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((uid, doc_id, piece, a, b - a, ids[4 * a : 4 * b]))
                        uid += 1
                yield pd.DataFrame(rows, columns=["uid", "doc_id", "piece", "start", "length", "ids"]).astype({"doc_id": "Int64"})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInPandas(run, "uid long, doc_id long, piece int, start long, length long, ids binary")


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and fill of each bin.

    Open bins are filed by what room they have left; a bit set of the rooms
    in use finds the tightest one."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    open_: list[list[int]] = [[] for _ in range(room + 1)]
    used = 0
    for i in order.tolist():
        size = int(sizes[i])
        fits = used >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = open_[left].pop()
            if not open_[left]:
                used &= ~(1 << left)
        else:
            left, b = room, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left -= size
        if left:
            open_[left].append(b)
            used |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _passed_on(fill: np.ndarray, room: int) -> np.ndarray:
    """Which bins a node passes on: those at most half full (there is one at
    most) and the emptiest others, as others' small bins may fit there."""
    keep = np.zeros(len(fill), bool)
    keep[np.argsort(fill, kind="stable")[: PASSED + 1]] = True
    return keep & (fill < room)


_ITEM = "uid long, node long, bin long, shift long, fill long, passed boolean"
_BIN = "node long, bin long, fill long, members array<struct<bin: long, shift: long>>, passed boolean"


def assign(items: DataFrame, room: int, scratch: Scratch) -> DataFrame:
    """(uid, sequence_id, offset) for items (uid, length) of at most ``room``.

    No task holds more than ``GROUP_ITEMS`` items or the bins that ``FAN_IN``
    nodes pass on, whatever the number of items."""

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        bins, shift, fill = best_fit(pdf["length"].to_numpy(), room)
        first = pd.Series(pdf["uid"].to_numpy()).groupby(bins).first().to_numpy()  # a bin is named by an item of it
        on = _passed_on(fill, room)
        return pd.DataFrame({"uid": pdf["uid"].to_numpy(), "node": pdf["node"].to_numpy(), "bin": first[bins], "shift": shift, "fill": fill[bins], "passed": on[bins]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin").reset_index(drop=True)
        bins, shift, fill = best_fit(pdf["fill"].to_numpy(), room)
        on, rows = _passed_on(fill, room), []
        for b, part in pdf.groupby(bins):
            members = [{"bin": int(m["bin"]), "shift": int(m["shift"] + shift[i])} for i, ms in part["members"].items() for m in ms]
            rows.append((int(pdf["node"].iloc[0]), int(part["bin"].min()), int(fill[b]), members, bool(on[b])))
        return pd.DataFrame(rows, columns=["node", "bin", "fill", "members", "passed"])

    n = items.count()
    nodes = max(1, -(-n // GROUP_ITEMS))
    dealt = items.select("uid", "length", F.expr(f"pmod(xxhash64(uid), {nodes}L)").alias("node"))
    packed = scratch.save(dealt.groupBy("node").applyInPandas(local, _ITEM))
    level = packed.where("passed").groupBy("node", "bin").agg(F.first("fill").alias("fill")).select(
        "node", "bin", "fill", F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("members")
    )
    moved = None
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        done = scratch.save(level.withColumn("node", F.floor(F.col("node") / FAN_IN)).groupBy("node").applyInPandas(merged, _BIN))
        final = done if nodes == 1 else done.where("not passed")
        rows = final.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select("sequence_id", F.col("m.bin").alias("bin"), F.col("m.shift").alias("base"))
        moved = rows if moved is None else moved.unionByName(rows)
        level = done.where("passed").select("node", "bin", "fill", "members")
    if moved is None:
        return packed.select("uid", F.col("bin").alias("sequence_id"), F.col("shift").alias("offset"))
    placed = packed.join(moved, "bin", "left")
    return placed.select("uid", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("shift") + F.coalesce("base", F.lit(0))).alias("offset"))


def pack(documents: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pieces with their token ids, and each piece's place in a sequence.

    Returns (pieces, places): uid, doc_id, piece, start, length, ids and uid,
    sequence_id, offset; they join one to one on uid.  A document is its ids
    by the ``tokenizers`` vocabulary file at ``vocabulary`` and then
    ``end_id``; only documents longer than ``length`` are cut, and their first
    piece may be shorter.

    Null text counts as empty and gives the one id ``end_id``; a null doc_id
    stays null; repeated rows are packed each; an empty table gives empty
    frames; columns beside doc_id and text are ignored.  Pieces of one size
    are placed in the order in which their group has them; which sequence each
    gets may differ from run to run, how full they are doesn't depend on it.
    """
    scratch = Scratch(documents.sparkSession)
    pieces = scratch.save(tokenise(documents, vocabulary, length, end_id))
    full = pieces.where(F.col("length") == length).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = assign(pieces.where(F.col("length") < length).select("uid", "length"), length, scratch)
    return pieces, full.unionByName(part)
