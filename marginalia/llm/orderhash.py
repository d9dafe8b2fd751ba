"""Near-duplicate classes by Order MinHash.

Shingles of five words carry the number of their occurrence.  Each sketch
takes the few with the smallest hashes and keeps them in text order, so that
it collides for texts that share these shingles in one order: for texts at a
small edit distance.  Texts that share a sketch are aligned within a band, and
those whose aligned shingles reach the similarity are linked; classes are the
connected components of the links.  First a text is aligned with the leader of
each of its sketches, then with every other text of them that is not yet in
its class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, worker_cache

#: Words of a shingle; similarity from which texts are linked.
WORDS, SIMILARITY = 5, 0.8
#: Sketches, and shingles that each takes.
SKETCHES, TAKEN = 16, 4
#: Texts of a sketch that are compared at once with as many others, and bins
#: of shingles that bound what two of them share.
BLOCK_TEXTS, BINS = 256, 128
#: Words whose hash a worker keeps.
CACHE_WORDS = 200_000

_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(29))


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the lower-cased words, which white space separates."""
    kept = worker_cache("word_hashes")
    get = kept.setdefault("words", _WordHashes()).__getitem__
    return np.array(list(map(get, text.lower().split())), _U)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of each run of ``WORDS`` words; of all words if there are fewer;
    none without words."""
    n = len(words)
    if n == 0:
        return words
    h = np.zeros(max(1, n - WORDS + 1), _U)
    for k in range(min(n, WORDS)):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + words[k : k + len(h)] + _U(k + 1))
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingles with the number of their occurrence."""
    by = np.argsort(h, kind="stable")
    s = h[by]
    head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    if len(head) == len(h):
        return h
    times = np.empty(len(h), np.int64)
    times[by] = np.arange(len(h)) - np.repeat(head, np.diff(np.r_[head, len(h)]))
    return np.where(times > 0, _mix(h + times.astype(_U) * _U(0xC2B2AE3D27D4EB4F)), h)


_SALTS = _mix(np.arange(1, SKETCHES + 1, dtype=_U) * _U(0x9FB21C651E98DF25))


def sketch_keys(h: np.ndarray) -> list[int]:
    """A key per sketch, and one per two neighbouring sketches: few texts
    share the latter without being alike, so a class is found at once even
    among many that share a passage."""
    if not len(h):
        return []
    own = labelled(h)
    values = _mix(own[None, :] ^ _SALTS[:, None])
    take = min(TAKEN, len(own))
    at = np.argpartition(values, take - 1, axis=1)[:, :take] if take < len(own) else np.tile(np.arange(len(own)), (SKETCHES, 1))
    at.sort(axis=1)
    key = _SALTS.copy()
    for c in range(take):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + own[at[:, c]])
    both = _mix(key * _U(0xD6E8FEB86659FD93) + np.roll(key, -1))
    return np.r_[key, both].view(np.int64).tolist()


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of a longest common subsequence; -1 if below ``least``.

    Furthest-reaching alignment over diagonals.  It needs no more than
    len(a) + len(b) - 2 * least differences, so diagonals lie in a band of
    that width."""
    n, m = len(a), len(b)
    short = min(n, m)
    if short < least:
        return -1
    differ = np.flatnonzero(a[:short] != b[:short])
    lead = int(differ[0]) if len(differ) else short
    a, b = a[lead:], b[lead:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return lead + tail if lead + tail >= least else -1
    most = n + m - 2 * least
    # compact the symbols: those of one side alone are differences anyway
    width = len(a) + len(b)
    if most < abs(len(a) - len(b)):
        return -1
    xs, ys, n, m = a.tolist(), b.tolist(), len(a), len(b)
    reach = {1: 0}
    for d in range(min(most, width) + 1):
        for k in range(-d, d + 1, 2):
            if k < -m or k > n:
                continue
            down = k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1))
            x = reach.get(k + 1, -1) if down else reach.get(k - 1, -1) + 1
            if x < 0:
                continue
            y = x - k
            while x < n and y < m and xs[x] == ys[y]:
                x += 1
                y += 1
            reach[k] = x
            if x >= n and y >= m:
                return lead + tail + (width - d) // 2
    return -1


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned shingles over all: c / (len(a) + len(b) - c); 0 below ``least``."""
    if not len(a) and not len(b):
        return 1.0
    need = int(np.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9))
    if min(len(a), len(b)) < need:
        return 0.0
    # shingles that occur in both, as often as in both: no alignment has more
    p, q = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(p[0], q[0], assume_unique=True, return_indices=True)
    if np.minimum(p[1][i], q[1][j]).sum() < need:
        return 0.0
    c = aligned(a, b, need)
    return c / (len(a) + len(b) - c) if c >= 0 else 0.0


def unlinked(seqs: list[np.ndarray], component: list[int], block: list[int], least: float) -> list[tuple[int, int]]:
    """Places of linked pairs that join all alike texts of different components.

    If there are two blocks, only pairs across them are compared.  Pairs are
    tried by what they can share at most, counted in bins of shingles, and
    left out once their components are one."""
    n = np.array([len(s) for s in seqs])
    bins = np.array([np.bincount((labelled(s) % _U(BINS)).astype(np.int64), minlength=BINS) for s in seqs], np.int32)
    comp, side, across = np.array(component), np.array(block), len(set(block)) > 1
    top: dict[int, int] = {}

    def find(c):
        while c in top:
            c = top[c]
        return c

    tried = []
    for i in range(len(seqs) - 1):
        need = np.ceil(least / (1 + least) * (n[i] + n[i + 1 :]) - 1e-9)
        ok = (comp[i + 1 :] != comp[i]) & (np.minimum(n[i], n[i + 1 :]) >= need)
        if across:
            ok &= side[i + 1 :] != side[i]
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            shared = np.minimum(bins[i], bins[j]).sum(axis=1)
            may = shared >= need[j - i - 1]
            j, shared = j[may], shared[may]
            tried += zip((shared / (n[i] + n[j] - shared)).tolist(), [i] * len(j), j.tolist(), strict=True)
    out = []
    for _, i, j in sorted(tried, key=lambda t: -t[0]):
        p, q = find(component[i]), find(component[j])
        if p != q and similarity(seqs[i], seqs[j], least) >= least:
            top[p] = q
            out.append((i, j))
    return out


def _digest(words: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(words.tobytes())


def classes(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """A row per document with its near-duplicate class.

    Returns doc_id, class_id (smallest doc_id of the class), class_size
    (rows), kept (doc_id is class_id), links (verified links of its text),
    text_hash (xxhash64 of the text, to find the row again).

    Texts with the same lower-cased words are one text.  Null text counts as
    empty; texts without words are one class; texts of fewer than five words
    have one shingle.  A null doc_id counts as the smallest.  Repeated rows of
    the doc_id that stays are all kept.  An empty table gives an empty one;
    other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession)
    docs = documents.select(F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))

    def sketch(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part, known, rows = pdf.iloc[at : at + 512], {}, []
                for i, t, h in zip(part["id"].tolist(), part["text"], part["hash"].tolist(), strict=True):
                    if t not in known:
                        w = word_hashes(t)
                        known[t] = (_digest(w), sketch_keys(shingles(w)))
                    rows.append((i, h, *known[t]))
                yield pd.DataFrame(rows, columns=["id", "hash", "digest", "keys"])

    sketched = scratch.save(docs.mapInPandas(sketch, "id long, hash long, digest string, keys array<long>"))
    sizes = scratch.save(sketched.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    # a text is numbered once, in a written table; repeated rows of its first doc_id are one
    texts = scratch.save(
        sketched.join(sizes, "digest").where("id = first").select("digest", "first", "n", "keys").dropDuplicates(["digest"]).withColumn("tid", F.monotonically_increasing_id())
    )
    keyed = scratch.save(texts.select("tid", F.explode("keys").alias("key")))
    leaders = scratch.save(keyed.groupBy("key").agg(F.min("tid").alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    pairs = scratch.save(keyed.join(leaders, "key").where("tid <> leader").select("tid", "leader").distinct())
    asked = pairs.select(F.explode(F.array("tid", "leader")).alias("tid")).distinct()
    asked = scratch.save(texts.select("tid", "first", "digest").join(asked, "tid").select("tid", F.col("first").alias("id"), "digest"))

    def sequence(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                rows = []
                for i, t, d in zip(pdf["tid"].iloc[at : at + 256], pdf["text"].iloc[at : at + 256], pdf["digest"].iloc[at : at + 256], strict=True):
                    w = word_hashes(t)
                    if _digest(w) == d:
                        rows.append((i, shingles(w).tobytes()))
                yield pd.DataFrame(rows, columns=["tid", "seq"])

    # the texts asked for grow with the corpus, so this is a merge join at every size
    seqs = scratch.save(docs.join(asked.hint("merge"), "id").select("tid", "text", "digest").mapInPandas(sequence, "tid long, seq binary").dropDuplicates(["tid"]))

    def verify(batches):
        for pdf in batches:
            ok = [similarity(np.frombuffer(x, _U), np.frombuffer(y, _U), least) >= least for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pdf.loc[ok, ["tid", "leader"]]

    sided = pairs.join(seqs.withColumnRenamed("seq", "x"), "tid").join(seqs.select(F.col("tid").alias("leader"), F.col("seq").alias("y")), "leader")
    links = scratch.save(sided.select("tid", "leader", "x", "y").mapInPandas(verify, "tid long, leader long"))
    scratch.drop(pairs, asked)
    joined = connected_components(links.select(F.col("tid").alias("a"), F.col("leader").alias("b")), scratch)

    # texts of a sketch beside its leader that are in several components yet; of sketches with the same texts one stays
    beside = keyed.join(leaders.where("c > 2"), "key").where("tid <> leader").select("key", "tid")
    beside = scratch.save(beside.join(joined.withColumnRenamed("node", "tid"), "tid", "left").select("key", "tid", F.coalesce("component", "tid").alias("component")))
    mark = lambda k: F.bit_xor(F.xxhash64("tid", F.lit(k)))
    open_keys = beside.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"), mark(1).alias("p"), mark(2).alias("q")).where("low <> high")
    open_keys = scratch.save(open_keys.groupBy("p", "q", "m").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / BLOCK_TEXTS).cast("int").alias("blocks")))
    dealt = beside.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("tid", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        tid = pdf["tid"].tolist()
        found = unlinked([np.frombuffer(s, _U) for s in pdf["seq"]], pdf["component"].tolist(), pdf["block"].tolist(), least)
        return pd.DataFrame([(max(tid[i], tid[j]), min(tid[i], tid[j])) for i, j in found], columns=["tid", "leader"])

    full = dealt.select("key", "lo", "hi", "tid", "component", "block").join(seqs, "tid")
    more = scratch.save(full.groupBy("key", "lo", "hi").applyInPandas(compare, "tid long, leader long").distinct())
    scratch.drop(keyed, leaders, beside, open_keys, seqs)
    if more.limit(1).count():
        first_links, links = links, scratch.save(links.unionByName(more))
        edges = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select(F.col("tid").alias("a"), F.col("leader").alias("b")))
        joined = connected_components(edges, scratch)
        scratch.drop(first_links)
    scratch.drop(more)
    degree = links.select(F.explode(F.array("tid", "leader")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    member = texts.select("tid", "digest", "first", "n").join(joined.withColumnRenamed("node", "tid"), "tid", "left").join(degree.withColumnRenamed("node", "tid"), "tid", "left")
    member = scratch.save(member.select("digest", "first", "n", F.coalesce("component", "tid").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    named = scratch.save(member.groupBy("component").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size")))
    of_text = scratch.save(member.join(named, "component").select("digest", "class_id", "class_size", "links"))
    scratch.drop(sizes, texts, links, member, named)
    out = sketched.select("id", "hash", "digest").join(of_text, "digest")
    real = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return out.select(real("id").alias("doc_id"), real("class_id").alias("class_id"), F.col("class_size").cast("long").alias("class_size"), (F.col("id") == F.col("class_id")).alias("kept"), F.col("links").cast("long").alias("links"), F.col("hash").alias("text_hash"))
