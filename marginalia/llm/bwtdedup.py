"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

1. Texts are laid out in blocks of about a megabyte.
2. Screening: each window of ``LENGTH`` bytes is named by the smallest hash of
   its grams.  Equal windows have equal names, so a name that occurs in one
   text alone rules out all its windows.
3. Around the remaining names, segments that hold just their windows go to
   buckets by name, each distinct one of a lot of blocks once.
4. In a bucket, shards of distinct segments get their transforms, and these
   are merged by interleave refinement: round h orders all suffixes by h
   symbols from the transforms alone, without sorting suffixes again, and
   splits the blocks of suffixes that agree on h symbols.  After ``LENGTH``
   rounds a block is a repeated interval, and the smallest doc_id of it tells
   which of its windows go.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, worker_cache

#: Bytes of a string that is removed; of a gram; grams in a window.
LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
#: Bytes of a block; names of a bucket; suffixes of a shard; windows of a segment.
BLOCK_BYTES, BUCKET_NAMES, SHARD_SUFFIXES, SEGMENT_WINDOWS = 1 << 20, 1 << 17, 1 << 17, 64
#: Blocks that send a bucket one row in common: rows are as many as lots times buckets.
LOT_BLOCKS = 16


def _hashes(body: np.ndarray) -> np.ndarray:
    """Hash of the gram at each position, by doubling its length."""
    h = body.astype(np.uint64) + np.uint64(1)
    m, k = 0x9E3779B97F4A7C15, 1
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    while k < GRAM:
        step = min(k, GRAM - k)  # the last one may overlap
        h = h[:-step] * np.uint64(m) + h[step:]
        h ^= h >> np.uint64(31)
        m, k = (m * m | 1) % 2**64, k + step
    return h


def window_names(body: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, name, text) of all windows, in order; windows lie in one text."""
    ends = np.cumsum(lengths)
    fits = np.maximum(lengths - LENGTH + 1, 0)
    none = np.array([], np.int64)
    if not fits.sum():
        return none, none.astype(np.uint64), none
    m, k = _hashes(body), 1
    while 2 * k <= SPAN:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    if k < SPAN:
        m = np.minimum(m[: -(SPAN - k)], m[SPAN - k :])
    text = np.repeat(np.arange(len(lengths)), fits)
    start = np.arange(len(text)) + np.repeat(ends - lengths - (np.cumsum(fits) - fits), fits)
    return start, m[start], text


def _runs(name: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where a run of windows with one name in one text begins."""
    return np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (text[1:] != text[:-1])]) if len(name) else np.array([], np.int64)


def _order(text: np.ndarray) -> np.ndarray:
    """Suffixes of a shard, each cut at the first 0, in order; ties keep their
    order, as if each 0 were smaller than the next one."""
    n = len(text)
    zero = np.flatnonzero(text == 0)
    left = zero[np.searchsorted(zero, np.arange(n))] - np.arange(n)
    rank, k = text.astype(np.int64), 1
    longest = int(left.max()) + 1
    while k < longest:
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = np.where(left[: n - k] >= k, rank[k:] + 1, 0)
        rank, k = rank * np.int64(rank.max() + 2) + ahead, 2 * k
        if k >= 4:  # before that, the pair fits as it is
            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    return np.argsort(rank, kind="stable")


def mixed(name: np.ndarray) -> np.ndarray:
    """Names spread evenly: a smallest hash crowds at the low end."""
    h = (name ^ (name >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of shards' transforms, and common prefixes of neighbours up
    to ``depth`` symbols.

    Symbol 0 ends a string; ends differ from each other, and those of earlier
    shards come first.  Returns for each place of the merged order its shard,
    and the length of the prefix its suffix has in common with the one before;
    a shard's own suffixes keep their order.  A boundary, once it is there,
    keeps its place, so the prefix is the number of rounds before it."""
    small = np.uint8 if len(transforms) < 256 else np.uint16
    shard = np.repeat(np.arange(len(transforms), dtype=small), [len(t) for t in transforms])
    symbols = np.concatenate(transforms)
    ends = np.repeat(np.arange(len(transforms), dtype=small), [int((t == 0).sum()) for t in transforms])
    block = np.zeros(len(shard), np.int32)
    merged = np.empty_like(symbols)
    new = np.ones(len(shard), bool)
    prefix = np.zeros(len(shard), np.uint8)
    for _ in range(depth):
        if block[-1] == len(block) - 1:
            break
        merged[np.argsort(shard, kind="stable")] = symbols
        # ends sort first and come from no suffix: what symbol 0 precedes falls away
        by = np.argsort(merged, kind="stable")[len(ends) :]
        head, below = merged[by], block[by]
        np.not_equal(head[1:], head[:-1], out=new[len(ends) + 1 :])
        new[len(ends) + 1 :] |= below[1:] != below[:-1]
        shard = np.concatenate([ends, shard[by]])
        block = np.cumsum(new, dtype=np.int32) - 1
        prefix += ~new
    return shard, prefix


def smallest_owner(segments: list[bytes], owners: np.ndarray, length: int = LENGTH, shard_suffixes: int = SHARD_SUFFIXES) -> list[np.ndarray]:
    """For each window of each distinct segment: the smallest owner of a
    segment that has it."""
    lens = np.array([len(s) for s in segments], np.int64)
    # no byte of UTF-8 is 255, so there is room for an end below all
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)
    stops = np.cumsum(lens + 1)
    cuts, base = [0], 0
    for e in stops.tolist():
        if e - base > shard_suffixes and cuts[-1] < e:
            cuts.append(e)
            base = e
    if cuts[-1] != len(text):
        cuts.append(len(text))
    transforms, places = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        sa = _order(text[a:b])
        transforms.append(np.where(sa > 0, text[a:b][sa - 1], 0).astype(np.uint8))
        places.append(sa + a)
    shard, prefix = merge_transforms(transforms, length)
    suffix = np.empty(len(text), np.int64)
    suffix[np.argsort(shard, kind="stable")] = np.concatenate(places)
    owner = np.repeat(owners, lens + 1)
    opens = prefix < length  # a repeated interval lasts while neighbours share that much
    opens[0] = True
    best = np.empty(len(text), np.int64)
    best[suffix] = np.minimum.reduceat(owner[suffix], np.flatnonzero(opens))[np.cumsum(opens) - 1]
    starts = stops - lens - 1
    return [best[s : s + max(0, n - length + 1)] for s, n in zip(starts.tolist(), lens.tolist(), strict=True)]


_BLOCK = "block long, ids binary, lengths binary, shas binary, body binary, carried binary"


def lay_out(documents: DataFrame) -> DataFrame:
    """Rows of whole texts, about ``BLOCK_BYTES`` each: doc_ids, byte lengths,
    SHA-256 and the bytes, compressed."""

    def run(batches):
        worker_cache("merged_transforms")  # lets go of what other operators hold
        n = TaskContext.get().partitionId() << 40
        pack = zstandard.ZstdCompressor(level=3)
        ids, texts, carried, size = [], [], [], 0

        def block():
            return pd.DataFrame(
                {
                    "block": [n],
                    "ids": [np.array(ids, np.int64).tobytes()],
                    "lengths": [np.array([len(t) for t in texts], np.int64).tobytes()],
                    "shas": [b"".join(hashlib.sha256(t).digest() for t in texts)],
                    "body": [pack.compress(b"".join(texts))],
                    "carried": [pack.compress(json.dumps(carried).encode())],
                }
            )

        for pdf in batches:
            for i, t, c in zip(pdf["id"].tolist(), pdf["text"], pdf["carried"], strict=True):
                carried.append(c)
                t = t.encode("utf-8", "replace")
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= BLOCK_BYTES or len(ids) >= 65_536:
                    yield block()
                    ids, texts, carried, size, n = [], [], [], 0, n + 1
        if ids:
            yield block()

    return documents.mapInPandas(run, _BLOCK)


def _body(row) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(row.body, max_output_size=max(1, int(np.frombuffer(row.lengths, np.int64).sum())))
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.lengths, np.int64), raw


def _lots(batches):
    """(lot, blocks) of blocks of one lot that follow each other."""
    return itertools.groupby((r for pdf in batches for r in pdf.itertuples()), lambda r: r.block // LOT_BLOCKS)


def dedup(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """What is left of each text without repeated strings.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts in
    a document with a smaller doc_id.  Strings are judged on the input, they
    overlap, and none crosses from one document into the next.  Returns
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes).

    Null text counts as empty, a null doc_id as smaller than any other.  Rows
    that share a doc_id don't remove each other's bytes.  Repeated rows are
    each returned; an empty table gives an empty one.  Of the other columns
    those named in ``carry`` are returned too.
    """
    scratch = Scratch(documents.sparkSession)
    packed = F.struct(F.lit(0).alias("_"), *carry)
    kind = documents.select(packed.alias("c")).schema["c"].dataType.simpleString()
    docs = documents.select(F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.to_json(packed).alias("carried"))
    blocks = scratch.save(lay_out(docs))

    # equal texts: all but those of the smallest doc_id go whole, so that only these are searched
    def rows(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ids, lengths = np.frombuffer(r.ids, np.int64), np.frombuffer(r.lengths, np.int64)
                shas = [r.shas[32 * i : 32 * i + 32] for i in range(len(ids))]
                yield pd.DataFrame({"block": r.block, "row": np.arange(len(ids)), "id": ids, "n": lengths, "sha": shas})

    texts = scratch.save(blocks.select("block", "ids", "lengths", "shas").mapInPandas(rows, "block long, row long, id long, n long, sha binary"))
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = texts.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    many = scratch.save(many)
    copies = scratch.save(texts.join(many, "sha").where("id > first").select("block", "row"))
    scratch.drop(texts, many)
    skipped = copies.groupBy("block").agg(F.collect_list("row").alias("skipped"))

    buckets = max(1, -(-total // (10 * BUCKET_NAMES)))
    span = 2**64 // buckets + 1

    def bucket_of(name):
        return (name // np.uint64(span)).astype(np.int64) if span < 2**64 else np.zeros(len(name), np.int64)

    def names(batches):
        for lot, blocks_of in _lots(batches):
            lows, homes, several, sizes = [], [], [], np.zeros(LOT_BLOCKS, np.int64)
            for r in sorted(blocks_of, key=lambda r: r.block):
                ids, lengths, raw = _body(r)
                _, name, text = window_names(np.frombuffer(raw, np.uint8), lengths)
                at = _runs(name, text)
                name, owner = mixed(name[at]), ids[text[at]]
                by = np.lexsort((owner, name))
                name, owner = name[by], owner[by]
                head = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else at
                sizes[r.block % LOT_BLOCKS] = len(head)
                if len(head):
                    several.append(np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head))
                    lows.append(name[head].astype(np.uint32))
                    homes.append(bucket_of(name[head]))
            if not lows:
                continue
            low, home, several = np.concatenate(lows), np.concatenate(homes), np.concatenate(several)
            by = np.argsort(home, kind="stable")
            low, home, several, block = low[by], home[by], several[by], np.repeat(np.arange(LOT_BLOCKS), sizes)[by]
            cut = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
            ends = np.r_[cut[1:], len(home)]
            counts = np.bincount(np.repeat(np.arange(len(cut)), ends - cut) * LOT_BLOCKS + block, minlength=len(cut) * LOT_BLOCKS).astype(np.uint32).reshape(-1, LOT_BLOCKS)
            yield pd.DataFrame(
                {
                    "bucket": home[cut],
                    "lot": lot,
                    "counts": [c.tobytes() for c in counts],
                    "low": [low[a:b].tobytes() for a, b in zip(cut, ends, strict=True)],
                    "several": [np.packbits(several[a:b]).tobytes() for a, b in zip(cut, ends, strict=True)],
                }
            )

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        lows = [np.frombuffer(x, np.uint32) for x in pdf["low"]]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(low)).astype(bool) for x, low in zip(pdf["several"], lows, strict=True)]
        every = np.sort(np.concatenate(lows))
        known = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[low[s] for low, s in zip(lows, several, strict=True)]]))
        kept, counts = [], []
        for low, sizes in zip(lows, pdf["counts"], strict=True):
            sizes = np.frombuffer(sizes, np.uint32)
            hit = known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low if len(known) else np.zeros(len(low), bool)
            kept.append(low[hit].tobytes())
            counts.append(np.bincount(np.repeat(np.arange(LOT_BLOCKS), sizes)[hit], minlength=LOT_BLOCKS).astype(np.uint32).tobytes())
        out = pd.DataFrame({"lot": pdf["lot"], "bucket": pdf["bucket"], "counts": counts, "low": kept})
        return out[out["low"].str.len() > 0]

    def by_block(pdf: pd.DataFrame) -> list[np.ndarray]:
        """A lot's remaining names, with their buckets, of each block in order."""
        if not len(pdf):
            return [np.array([], np.uint64)] * LOT_BLOCKS
        counts = np.stack([np.frombuffer(c, np.uint32) for c in pdf["counts"]]).astype(np.int64)
        home = np.repeat(pdf["bucket"].to_numpy().astype(np.uint64), counts.sum(axis=1))
        key = (home << np.uint64(32)) | np.frombuffer(b"".join(pdf["low"]), np.uint32).astype(np.uint64)
        block = np.repeat(np.tile(np.arange(LOT_BLOCKS, dtype=np.uint8), len(counts)), counts.ravel())
        by = np.argsort(block, kind="stable")
        return [np.sort(k) for k in np.split(key[by], np.cumsum(counts.sum(axis=0))[:-1])]

    named = blocks.select("block", "ids", "lengths", "body").mapInPandas(names, "bucket long, lot long, counts binary, low binary, several binary")
    screened = scratch.save(named.groupBy("bucket").applyInPandas(shared, "lot long, bucket long, counts binary, low binary"))

    def segments(lot, bodies: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "lot", "lens", "segs", "names", "least", "place", "begin", "of", "own"]
        copied = asked["bucket"].isna()
        keys, gone = by_block(asked[~copied]), asked[copied]
        index: dict[bytes, int] = {}
        whiches, homes, lows, begins, owns, sizes = [], [], [], [], [], np.zeros(LOT_BLOCKS, np.int64)
        for r in bodies.sort_values("block").itertuples():
            key = keys[r.block % LOT_BLOCKS]
            if not len(key):
                continue
            ids, lengths, raw = _body(r)
            start, name, text = window_names(np.frombuffer(raw, np.uint8), lengths)
            at = _runs(name, text)
            stop = np.r_[at[1:], len(name)]
            name = mixed(name[at])
            bucket, low = bucket_of(name), name.astype(np.uint32)
            own = (bucket.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
            hit = key[np.minimum(np.searchsorted(key, own), len(key) - 1)] == own
            hit &= ~np.isin(text[at], gone.loc[gone["of"] == r.block % LOT_BLOCKS, "row"].to_numpy(np.int64))
            at, stop, bucket, low = at[hit], stop[hit], bucket[hit], low[hit]
            # long runs (of text that repeats itself) in parts
            parts = -(-(stop - at) // SEGMENT_WINDOWS)
            part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at = np.repeat(at, parts) + part * SEGMENT_WINDOWS
            begin = start[at]
            end = begin + np.minimum(SEGMENT_WINDOWS, np.repeat(stop, parts) - at) + LENGTH - 1
            whiches.append(np.array([index.setdefault(raw[x:y], len(index)) for x, y in zip(begin.tolist(), end.tolist(), strict=True)], np.int64))
            homes.append(np.repeat(bucket, parts))
            lows.append(np.repeat(low, parts))
            begins.append(begin.astype(np.int32))
            owns.append(ids[text[at]])
            sizes[r.block % LOT_BLOCKS] = len(at)
        if not index:
            return pd.DataFrame([], columns=columns)
        which, begin, own = np.concatenate(whiches), np.concatenate(begins), np.concatenate(owns)
        block = np.repeat(np.arange(LOT_BLOCKS, dtype=np.uint8), sizes)
        n = len(index)
        least = np.full(n, 2**63 - 1, np.int64)
        np.minimum.at(least, which, own)
        home, key = np.empty(n, np.int64), np.empty(n, np.uint32)
        home[which], key[which] = np.concatenate(homes), np.concatenate(lows)
        order = np.argsort(home, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        segs = list(index)
        uses = np.argsort(place[which], kind="stable")  # occurrences by bucket
        cut = np.flatnonzero(np.r_[True, home[order][1:] != home[order][:-1]])
        use_cut = np.searchsorted(place[which][uses], cut)
        rows = []
        for a, b, c, d in zip(cut.tolist(), [*cut[1:].tolist(), n], use_cut.tolist(), [*use_cut[1:].tolist(), len(uses)], strict=True):
            mine, used = order[a:b], uses[c:d]
            here = [segs[i] for i in mine.tolist()]
            rows.append(
                (
                    int(home[mine[0]]),
                    int(lot[0]),
                    bytes(map(len, here)),
                    b"".join(here),
                    key[mine].tobytes(),
                    least[mine].tobytes(),
                    (place[which[used]] - a).astype(np.int32).tobytes(),
                    begin[used].tobytes(),
                    block[used].tobytes(),
                    own[used].tobytes(),
                )
            )
        return pd.DataFrame(rows, columns=columns)

    lot = F.expr(f"block div {LOT_BLOCKS}")
    asked = screened.select("lot", "bucket", "counts", "low", F.lit(None).cast("int").alias("of"), F.lit(None).cast("long").alias("row")).unionByName(
        copies.select(lot.alias("lot"), F.expr(f"cast(block % {LOT_BLOCKS} as int)").alias("of"), "row"), allowMissingColumns=True
    )
    bodies = blocks.select(lot.alias("lot"), "block", "ids", "lengths", "body")
    sent = "bucket long, lot long, lens binary, segs binary, names binary, least binary, place binary, begin binary, of binary, own binary"
    found = scratch.save(bodies.groupBy("lot").cogroup(asked.groupBy("lot")).applyInPandas(segments, sent))

    scratch.drop(screened)

    def owners(pdf: pd.DataFrame) -> pd.DataFrame:
        index: dict[bytes, int] = {}
        uses = []
        for lens, segs in zip(pdf["lens"], pdf["segs"], strict=True):
            ends = np.cumsum(np.frombuffer(lens, np.uint8).astype(np.int64)).tolist()
            uses.append(np.array([index.setdefault(segs[a:b], len(index)) for a, b in zip([0, *ends], ends, strict=False)], np.int64))
        segments, every = list(index), np.concatenate(uses)
        least = np.full(len(segments), 2**63 - 1, np.int64)
        np.minimum.at(least, every, np.frombuffer(b"".join(pdf["least"]), np.int64))
        name = np.empty(len(segments), np.uint32)
        name[every] = np.frombuffer(b"".join(pdf["names"]), np.uint32)
        # a segment that is alone under its name has its windows to itself; the others' may be in each other
        _, kind, variants = np.unique(name, return_inverse=True, return_counts=True)
        several = np.flatnonzero(variants[kind] > 1)
        best = [np.full(len(x) - LENGTH + 1, o) for x, o in zip(segments, least.tolist(), strict=True)]
        if len(several):
            for i, w in zip(several.tolist(), smallest_owner([segments[i] for i in several.tolist()], least[several]), strict=True):
                best[i] = w
        # per segment: runs of windows with one smallest owner
        flat = np.concatenate(best)
        size = np.array([len(w) for w in best], np.int64)
        opens = np.r_[True, flat[1:] != flat[:-1]]
        opens[np.cumsum(size)[:-1]] = True
        at = np.flatnonzero(opens)
        runs, owner = np.diff(np.r_[at, len(flat)]).astype(np.uint8), flat[at]
        count = np.add.reduceat(opens, np.cumsum(size) - size)
        first = np.cumsum(count) - count
        counts, sizes, firsts = [], [], []
        for use in uses:
            per = count[use]
            pick = np.repeat(first[use] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            counts.append(per.astype(np.uint8).tobytes())
            sizes.append(runs[pick].tobytes())
            firsts.append(owner[pick].tobytes())
        return pd.DataFrame({"lot": pdf["lot"], "bucket": pdf["bucket"], "counts": counts, "sizes": sizes, "owners": firsts})

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        """Runs of windows that go, by block: where they begin, and how many."""
        whole = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
        counts, sizes, least = whole("counts", np.uint8).astype(np.int64), whole("sizes", np.uint8).astype(np.int64), whole("owners", np.int64)
        segments_of, uses_of = pdf["counts"].str.len().to_numpy(), pdf["of"].str.len().to_numpy()
        place = whole("place", np.int32) + np.repeat(np.cumsum(segments_of) - segments_of, uses_of)
        run0 = np.cumsum(counts) - counts
        per = counts[place]
        run = np.repeat(run0[place] - (np.cumsum(per) - per), per) + np.arange(per.sum())
        inside = np.cumsum(sizes) - sizes  # windows before each run, over all segments
        older = least[run] < np.repeat(whole("own", np.int64), per)
        at = (np.repeat(whole("begin", np.int32) - inside[run0[place]], per) + inside[run])[older].astype(np.int32)
        size, block = sizes[run[older]].astype(np.uint8), np.repeat(whole("of", np.uint8), per)[older]
        by = np.argsort(block, kind="stable")
        at, size, cuts = at[by], size[by], np.searchsorted(block[by], np.arange(LOT_BLOCKS + 1))
        rows = [(int(pdf["lot"].iloc[0]) * LOT_BLOCKS + i, at[a:b].tobytes(), size[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if a < b]
        return pd.DataFrame(rows, columns=["block", "at", "sizes"])

    judged = found.select("bucket", "lot", "lens", "segs", "names", "least").groupBy("bucket").applyInPandas(owners, "lot long, bucket long, counts binary, sizes binary, owners binary")
    answers = found.select("lot", "bucket", "place", "begin", "of", "own").join(judged, ["lot", "bucket"]).groupBy("lot").applyInPandas(placed, "block long, at binary, sizes binary")
    answers = scratch.save(answers)
    scratch.drop(found)

    def cut(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ids, lengths, raw = _body(r)
                ends = np.cumsum(lengths)
                begin = ends - lengths
                edge = np.zeros(len(raw) + 1, np.int32)
                if r.at is not None:
                    at = np.frombuffer(r.at, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + np.frombuffer(r.sizes, np.uint8).astype(np.int64) + LENGTH - 1, -1)
                covered = np.cumsum(edge[:-1]) > 0
                for i in np.asarray(r.skipped if r.skipped is not None else [], np.int64):
                    covered[begin[i] : ends[i]] = lengths[i] >= LENGTH
                body = np.frombuffer(raw, np.uint8)
                out, carried = [], json.loads(zstandard.ZstdDecompressor().decompress(r.carried))
                for i in range(len(ids)):
                    c = covered[begin[i] : ends[i]]
                    spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum())
                    out.append((ids[i], lengths[i], int(c.sum()), spans, body[begin[i] : ends[i]][~c].tobytes(), carried[i]))
                yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept", "carried"])

    last = blocks.select("block", "ids", "lengths", "body", "carried").join(answers, "block", "left").join(skipped, "block", "left")
    done = last.mapInPandas(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary, carried string")
    named = F.from_json("carried", kind)
    return done.select(F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", *[named[c].alias(c) for c in carry])
