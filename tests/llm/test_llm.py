"""Training-data operators against brute force and the libraries."""

import binascii
import glob
import hashlib
import os
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from marginalia.llm import bwtdedup, common, exactdedup, htmltext, imatch, langid, orderhash, packing, pieces, sharding, urlrules
from marginalia.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi") for b in ("ra", "te", "no", "su") for c in ("", "n", "sh", "ling")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    """Plain texts, exact and near copies, shared passages, odd rows."""
    rng = random.Random(seed)
    passage = prose(rng, 30)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    for i in range(0, n, 7):
        texts[i] = texts[i] + " " + passage + " " + prose(rng, 5)
    for i in range(3, n, 9):
        texts[i] = texts[i - 2].upper() if i % 2 else texts[i - 2]
    for i in range(5, n, 11):
        ws = texts[i - 1].split()
        ws[len(ws) // 2] = "changed"
        texts[i] = " ".join(ws)
    texts += ["", "   ", "a", "é" * 70, "日本語" * 30, "ha " * 200, "ha " * 190, None, "x" * 49, "x" * 50]
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", len(t or ""), "e") for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "a null id", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1. Sharding


def test_shards_are_even_and_gapless(spark, docs):
    rows = sharding.shard_by_bytes(docs, 4).collect()
    assert len(rows) == docs.count()
    sizes, slots = {}, {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * longest
    text = {i: t or "" for i, t, *_ in corpus()}
    for r in rows:
        t = text[r["doc_id"]].encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == binascii.crc32(t)


def test_a_hot_text_is_cut_between_ids(spark):
    rows = [(i, "same text") for i in range(400)] + [(i, f"text {i}") for i in range(400, 600)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).collect()
    sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(8)]
    assert max(sizes) <= 1.05 * min(sizes)


def test_shards_of_nothing_and_of_one_repeated_row(spark, empty):
    assert sharding.shard_by_bytes(empty).count() == 0
    same = spark.createDataFrame([(1, "t")] * 20, "doc_id long, text string")
    assert sharding.shard_by_bytes(same, 4).count() == 20


# 2. Packing


def test_token_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    own, lib = packing.ByteBpe(path), Tokenizer.from_file(path)
    for t in [t or "" for _, t, *_ in corpus()] + ["a  b \n c", "<|endoftext|>x <|endoftext|>", "it's 12,5% – ja", "\t\tx\x00y"]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_best_fit_is_tight():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 500)
    bins, offsets, fill = packing.best_fit(sizes, 100)
    assert fill.max() <= 100 and len(fill) <= 1.05 * np.ceil(sizes.sum() / 100) + 1
    for b in range(len(fill)):
        inside = sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b))
        at = 0
        for o, s in inside:
            assert o == at
            at += s


def test_packing_keeps_every_token(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 8)  # so that groups merge
    monkeypatch.setattr(packing, "FAN_IN", 2)
    cut, places = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), 64)
    rows = cut.join(places, "uid").collect()
    assert len(rows) == cut.count()
    by_doc, by_seq = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] <= 256
        by_doc.setdefault((r["doc_id"], r["uid"] - r["piece"]), []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(by_doc) == docs.count()
    for parts in by_doc.values():
        parts.sort(key=lambda r: r["piece"])
        assert [p["start"] for p in parts] == list(np.cumsum([0, *(p["length"] for p in parts[:-1])]))
        assert all(p["length"] == 64 for p in parts[1:])
    for spans in by_seq.values():
        spans.sort()
        assert [o for o, _ in spans] == list(np.cumsum([0, *(n for _, n in spans[:-1])])) and sum(n for _, n in spans) <= 64
    assert len(by_seq) <= 1.2 * sum(r["length"] for r in rows) / 64 + 2
    cut, places = packing.pack(empty, tokenizer_file("byte_bpe_50k.json"))
    assert cut.count() == 0 and places.count() == 0


# 3. Exact dedup


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 1000, 5000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        f = exactdedup.FuseFilter.build(keys)
        assert f.contains(keys).all()
        assert f.contains(rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.001


@pytest.mark.parametrize("digest", [None, lambda sha: F.substring(sha, 1, 1)])
def test_exact_groups(spark, docs, digest):
    half = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    rows = exactdedup.dedup(docs.where(half), docs.where(~half), digest).collect()
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault(fold(t), []).append(i)
    want = sorted((str(i), str(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in rows) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in rows)


def test_a_snapshot_is_built_once(spark, docs, tmp_path):
    half = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    exactdedup.build(docs.where(half), str(tmp_path / "built"))
    want = sorted(map(tuple, exactdedup.dedup(docs.where(half), docs.where(~half)).collect()), key=str)
    for _ in range(2):
        got = exactdedup.dedup(docs.where(half), docs.where(~half), built=str(tmp_path / "built"))
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_a_hot_text_is_salted(spark):
    rows = [(i, "The Same" if i % 3 else f"text {i}", "x", 0) for i in range(1000)] + [(5, "the same", "x", 0), (None, "the SAME", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, kept int")
    got = exactdedup.dedup_table(df).collect()
    assert len(got) == 1002 and sum(r["kept"] for r in got) == 335
    assert {(r["keep_id"], r["group_size"]) for r in got if r["group_size"] > 1} == {(998, 668)}


def test_exact_of_nothing(empty, docs):
    assert exactdedup.dedup_table(empty).count() == 0
    assert exactdedup.dedup(empty, docs).count() == docs.count()


# 4. HTML


PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><nav><a>Home</a></nav><div class='ad'>Buy</div>{}<footer>&copy; x</footer><script>var a='</p>';</script>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>Head &amp; tail</h1><p>One <b>bold</b>\n text<br>next<p>Two</article>", "Head & tail One bold text next Two"),
        ("<article><p>Body</p><div class='comments'><p>Nice</p></div><form>Name</form></article>", "Body"),
        ("<main>In <!-- no --> main</main><aside>Out</aside>", "In main"),
        ("<div>Plain</div>", "Plain"),
        ("<article><div class='cookie-notice'>We<div>use</div>them</div><p>Kept", "Kept"),
        ("<article><section class='social policy'><p>Real text</p></section><p class='notice header related'>More</p></article>", "Real text More"),
        ("<article><header>By <h1>Title</h1>May 1</header><p>Text</article>", "Title Text"),
        ("<main><article><p>Own</p><article class='reader-feedback'><p>A comment</p></article><p>End</p></article></main>", "Own End"),
        ("<article><p>Own</p><ol><li itemprop=comment>Nice</ol><p hidden>No</p></article>", "Own"),
        ("<div data-class='ad'>Kept</div><div class='ad'>Buy</div>", "Kept"),
        ("", ""),
    ],
)
def test_blocks(spark, body, text):
    pages = spark.createDataFrame([(1, "http://h.org/", PAGE.format(body))], "page_id long, url string, html string")
    assert htmltext.main_text(pages).first()["text"] == text


def test_repeated_runs_go_where_no_article_is_marked(spark):
    menu = "all pages of this site share these very words in a row"
    rows = [(i, f"http://h.org/{i}", f"<body><div>{menu}</div><div>{i} is the page that says thing number {i * 7}</div>", "x") for i in range(5)]
    rows += [(9, None, None, "x"), (10, "odd", "", None), (11, "http://h.org/a", f"<article>{menu}</article>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(pages).collect()}
    assert got == {i: f"{i} is the page that says thing number {i * 7}" for i in range(5)} | {9: "", 10: "", 11: menu}
    assert htmltext.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("group_bytes", [1 << 23, 1 << 14])
def test_a_large_hosts_runs_are_counted_over_all_its_pages(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(htmltext, "GROUP_BYTES", group_bytes)
    menu, notice = "a few pages of this very large site share these words in a row", "most articles of the site have this short notice in them"
    own = lambda i: " ".join(f"p{i}w{k}" for k in range(20))
    rows = [(i, f"http://h.org/{i}", f"<body><div>{menu if i % 25 == 0 else ''}</div><div>{own(i)}</div>") for i in range(400)]
    rows += [(1000 + i, f"http://h.org/{i}", f"<article><p>{notice}</p>{own(1000 + i)}{menu if i % 25 == 0 else ''}</article>") for i in range(600)]
    rows += [(5000 + i, f"http://h.org/x{i}", f"<body><div>twice is not enough for these ten words here {i}</div>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["removed_tokens"]) for r in htmltext.main_text(pages).collect()}
    want = {i: (own(i), 14 if i % 25 == 0 else 0) for i in range(400)}
    # a menu that few articles quote stays in them, a notice that most have goes
    want |= {1000 + i: (f"{own(1000 + i)}{menu if i % 25 == 0 else ''}", 11) for i in range(600)}
    assert got == want | {5000 + i: (f"twice is not enough for these ten words here {i}", 0) for i in range(2)}


def test_menus_are_found_by_the_suffix_array(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    assert htmltext.main_text(rows).agg({"removed_tokens": "sum"}).first()[0] > 0


def test_copies_of_a_page_keep_their_text(spark):
    text = "one page without any article that was copied five times as it is"
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", f"<body><div>{text}</div>") for i in range(5)], "page_id long, url string, html string")
    assert [r["text"] for r in htmltext.main_text(pages).collect()] == [text] * 5
    near = spark.createDataFrame([(i, f"http://h.org/{i}", f"<body><div>{text} {text[::-1]} copy {i}</div>") for i in range(5)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in htmltext.main_text(near).collect()} == {i: f"{text} {text[::-1]} copy {i}" for i in range(5)}


def test_a_very_long_page(spark):
    text = " ".join(f"word{i % 7919}" for i in range(200_000))
    pages = spark.createDataFrame([(1, "http://h.org/", f"<article><p>{text}</article>"), (2, "http://h.org/", "<b>" * 50_000 + "end")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in htmltext.main_text(pages).collect()} == {1: text, 2: "end"}


def test_repeats_against_brute_force():
    rng = np.random.default_rng(3)
    tokens, page = rng.integers(0, 3, 400), np.repeat(np.arange(8), 50)
    n, want = htmltext.RUN_TOKENS, np.zeros(400, bool)
    runs = {}
    for i in range(400 - n + 1):
        if page[i] == page[i + n - 1]:
            runs.setdefault(tuple(tokens[i : i + n]), []).append(i)
    for at in runs.values():
        if len({page[i] for i in at}) >= htmltext.RUN_PAGES:
            for i in at:
                want[i : i + n] = True
    assert (htmltext.repeated(tokens, page) == want).all()


# 5. Repeated byte strings


def brute_force_cut(rows):
    seen, out = {}, []
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            key = -(2**63) if i is None else i
            seen[s] = min(seen.get(s, key), key)
    for i, t, *_ in rows:
        b, key = (t or "").encode(), -(2**63) if i is None else i
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < key:
                gone[k : k + 50] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((str(i), len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_cut_against_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(bwtdedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(bwtdedup, "BUCKET_NAMES", 50)
    got = bwtdedup.dedup(docs, ("lang",)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == brute_force_cut(corpus())
    lang = {i: x for i, _, x, *_ in corpus()}
    assert all(r["lang"] == lang[r["doc_id"]] for r in got)


def test_merge_of_transforms_against_sorting():
    rng = random.Random(5)
    base = "".join(rng.choice("ab") for _ in range(300)).encode()
    segments = list({base[i : i + rng.randint(10, 40)] for i in range(0, 260, 7)})
    owners = np.array([rng.randint(0, 50) for _ in segments])
    best = bwtdedup.smallest_owner(segments, owners, length=10, shard_suffixes=100)
    least = {}
    for s, o in zip(segments, owners, strict=True):
        for k in range(len(s) - 9):
            least[s[k : k + 10]] = min(least.get(s[k : k + 10], 99), o)
    for s, w in zip(segments, best, strict=True):
        assert w.tolist() == [least[s[k : k + 10]] for k in range(len(s) - 9)]


def test_cut_sends_a_row_for_a_lot_and_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(bwtdedup, "BLOCK_BYTES", 500)
    monkeypatch.setattr(bwtdedup, "BUCKET_NAMES", 50)
    rng, saved = random.Random(3), []
    base = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(40)]
    rows = [(i, rng.choice(base)[rng.randint(0, 9) :] + str(i) + rng.choice(base)) for i in range(300)]
    keep = common.Scratch.save
    monkeypatch.setattr(common.Scratch, "save", lambda self, df: saved.append(out := keep(self, df)) or saved[-1])
    monkeypatch.setattr(common.Scratch, "drop", lambda self, *tables: None)
    got = bwtdedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == brute_force_cut(rows)
    blocks = saved[0].count()
    sent = [t for t in saved if "bucket" in t.columns]
    buckets = max(t.select("bucket").distinct().count() for t in sent)
    assert blocks > 50 and buckets > 50 and len(sent) == 2
    assert all(t.count() <= -(-blocks // 16) * buckets for t in sent)


def test_cut_of_nothing(empty):
    assert bwtdedup.dedup(empty).count() == 0


# 6. Near-duplicates


def test_alignment_against_dynamic_programming():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64)
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert orderhash.aligned(a, b, 0) == best[-1, -1]
        assert orderhash.aligned(a, b, best[-1, -1] + 1) == -1


def test_classes_against_all_pairs(spark, docs, empty):
    rows = {i: t or "" for i, t, *_ in corpus()}
    ids = sorted(rows, key=lambda i: (i is not None, i))
    seqs = {i: orderhash.shingles(orderhash.word_hashes(rows[i])) for i in ids}
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if orderhash.similarity(seqs[a], seqs[b]) >= 0.8:
                p, q = sorted((find(a), find(b)), key=ids.index)
                top[q] = p
    got = orderhash.classes(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: find(i) for i in ids}
    assert orderhash.classes(empty).count() == 0


def test_copies_that_are_alike_through_their_original_alone(spark):
    rng = random.Random(11)
    original = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(300):
        ws = list(original)
        for at in rng.sample(range(400), 8):
            ws[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(original if i == 150 else ws)))
    # texts that share a passage and are not alike
    rows += [(1000 + i, " ".join(original[:60] + [f"y{rng.randrange(10**9)}" for _ in range(60)])) for i in range(300)]
    seqs = [orderhash.shingles(orderhash.word_hashes(t)) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            if find(x) != find(y) and orderhash.similarity(seqs[x], seqs[y]) >= 0.8:
                p, q = sorted((find(x), find(y)))
                top[q] = p
    got = {r["doc_id"]: r["class_id"] for r in orderhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
    assert sum(c == 0 for c in got.values()) > 250


def test_blocks_of_a_sketch_find_every_class(monkeypatch, spark, docs):
    want = {(r["doc_id"], r["class_id"]) for r in orderhash.classes(docs).collect()}
    monkeypatch.setattr(orderhash, "BLOCK_TEXTS", 2)
    assert {(r["doc_id"], r["class_id"]) for r in orderhash.classes(docs).collect()} == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (200, 200)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark)).collect()
    assert {r["node"]: r["component"] for r in got} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}


# 7. Fingerprints


def test_fingerprints(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 10)
    rows = imatch.edited_fingerprints(docs, (0.0, 0.5)).collect()
    assert len(rows) == docs.count()
    order = sorted(corpus(), key=lambda r: (r[0] is not None, r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()))
    text = [r[1] or "" for r in order]
    want = {}
    for k, (i, *_) in enumerate(order):
        t, following, cut = text[k], text[(k + 1) % len(order)], len(text[k]) // 4
        want.setdefault(i, set()).add(hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest())
    assert all(r["edited_sha256"] in want[r["doc_id"]] for r in rows)
    same = {}
    for r in rows:
        same.setdefault(dict((i, t or "") for i, t, *_ in corpus())[r["doc_id"]], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in same.values())
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows])
    assert imatch.edited_fingerprints(empty).count() == 0


def brute_force_prints(rows, band):
    """doc_id -> (edited text, fingerprint, edited fingerprint, near_edited, near_next)."""
    import struct

    import xxhash

    hashed = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    terms = lambda t: set(regex.split(r"[^\p{L}\p{N}]+", t.lower())) - {""}
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    docs = sorted(((-(2**63) if i is None else i, t or "") for i, t in rows), key=lambda r: (r[0], sha(r[1])))
    n, df = len(docs), {}
    for _, t in docs:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    lexicon = {w for w, c in df.items() if max(2, band[0] * n) <= c <= band[1] * n}
    levels = list(imatch.LEVELS)

    def prints(text):
        cells = {}
        for w in terms(text) & lexicon:
            h = hashed(w.encode())
            for f in range(imatch.FAMILIES):
                mine = hashed(struct.pack("<i", f), h)
                for i, r in enumerate(levels):
                    if mine & (2**r - 1) == 0:
                        cells.setdefault(f * len(levels) + i, []).append(signed(h))
        out = []
        for c, hs in cells.items():
            h = 42
            for x in sorted(hs):
                h = hashed(struct.pack("<q", x), h)
            out.append(f"{c:02d}:{len(hs)}:{h % 2**32:08X}")
        return " ".join(sorted(out)) or f"={hashed(text.encode()):X}"

    def like(a, b):
        if a == b or "=" in (a[0], b[0]):
            return float(a == b)
        p, q = ({tuple(s.split(":")) for s in x.split(" ")} for x in (a, b))
        few = lambda s: {x for x in s if x[1] in ("1", "2")}
        if few(p) or few(q):
            return len(few(p) & few(q)) / len({x[0] for x in few(p) | few(q)})
        return len(p & q) / len({x[0] for x in p | q})

    out = []
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % n][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        out.append((None if i == -(2**63) else i, len(t), sha(edited), prints(t), prints(edited), like(prints(t), prints(edited)), like(prints(t), prints(after))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("quantiles", "range_rows"), [(4096, 1024), (4096, 7), (3, 5)])
def test_fingerprints_against_brute_force(spark, monkeypatch, quantiles, range_rows):
    monkeypatch.setattr(imatch, "QUANTILES", quantiles)
    monkeypatch.setattr(imatch, "RANGE_ROWS", range_rows)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None, "one more"), (10**15, None), (10**15, "twice the same id"), (-5, "W" * 3 + " ähnlich x2")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, part string, id int")
    assert sorted((tuple(r) for r in imatch.edited_fingerprints(df).collect()), key=str) == brute_force_prints(rows, imatch.BAND)


# 8. Languages


def test_automaton_knows_all_substrings():
    text = [1, 2, 1, 2, 3, 1, 1, 2]
    nxt = langid.suffix_automaton(text)

    def known(s):
        at = 0
        for c in s:
            if c not in nxt[at]:
                return False
            at = nxt[at][c]
        return True

    subs = {tuple(text[i:j]) for i in range(8) for j in range(i + 1, 9)}
    assert all(known(s) for s in subs)
    assert all(known(s) == (s in subs) for s in [(a, b, c) for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)])


def test_held_out_accuracy(spark, empty):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert langid.identify(empty).count() == 0


def test_phrases_are_those_of_whole_texts():
    rng = random.Random(8)
    sample = {"xx": [prose(rng, 300)], "yy": ["".join(rng.choice("аеиноств \u3042\u3044\u3046") for _ in range(2000))], "zz": ["ab " * 40]}
    parser = langid.CrossParser(sample)
    texts = [prose(rng, rng.randint(1, 900)) for _ in range(12)] + ["ab " * 900, "ab" * 1500 + "c", "", "!", "а" * 700, "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(600))]
    got, _ = parser.phrases(texts)
    for k, lang in enumerate(parser.languages):
        of = parser.alphabets[k].of
        own = "".join(chr(c) for c in of[parser.letters.split([" ".join(sample[lang])])[0]])
        for i, t in enumerate(texts):
            symbols = "".join(chr(c) for c in of[parser.letters.split([t])[0]])
            n, at = 0, 0
            while at < len(symbols):
                end = at + 1
                while end < len(symbols) and symbols[at : end + 1] in own:
                    end += 1
                n, at = n + 1, end
            assert got[k, i] == n


def test_language_of_scripts_and_carried_columns(spark):
    rng = random.Random(9)
    scripts = {"la": "etaoinshrdlu", "cy": "оеаинтсрвлкм", "gr": "αοιετσνηρκπυ", "cj": "".join(chr(0x4E00 + 7 * i) for i in range(800))}
    rows = [(i, "".join(rng.choice(scripts[g] + "  ") for _ in range(300)), g) for i in range(200) for g in [list(scripts)[i % 4]]]
    df = spark.createDataFrame([(*r, 0.5, None) for r in rows], "doc_id long, text string, lang string, score double, held_out string")
    got = langid.identify(df, ("text", "lang", "score", "held_out")).collect()
    assert all(r["lang"] == r["lang_pred"] and r["score_given"] == 0.5 and r["held_out_given"] is None for r in got) and len(got) == 200


def test_undetermined(spark):
    rows = [(i, "the cat sat on the mat and it sat", "en") for i in range(9)] + [(20, "123 !!", "en"), (21, None, None), (22, "le chat", None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, carried string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    assert got[20] == got[21] == ("und", 0.0) and got[22][0] == "en"
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(none).first()["lang_pred"] == "und"


# 9. Pieces


def test_pieces_are_the_librarys():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    own, lib = pieces.PieceBpe(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    texts = [t or "" for _, t, *_ in corpus()] + ["  a  b ", "▁x ▁", "z" * 300 + " ab" * 3, "<s> <unk> </s>", "\x00 é🎉"]
    texts += ["".join(rng.choice("ab the\n▁é日🎉") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    for t in texts:
        words = pieces.words_of(t)
        ids = [i for w in own.encode_words([pieces.BLANK + w.replace(" ", pieces.BLANK) for w in words]) for i in w]
        assert ids == lib.encode(t)
        assert own.decode(ids) == lib.decode(ids)


def test_rounds_over_long_words_are_the_librarys(monkeypatch):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    own, lib = pieces.PieceBpe(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    names = [lib.id_to_piece(i) for i in range(300, lib.get_piece_size())]
    words = ["".join(rng.choice(names).replace(pieces.BLANK, "") for _ in range(rng.randint(1, 400))) for _ in range(150)]
    words += ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 3000))) for _ in range(30)] + ["a" * k for k in (1, 2, 3, 255, 256, 257, 5001)] + ["z9é🎉\u3042" * 999]
    words += ["".join(rng.choice(names).replace(pieces.BLANK, "") for _ in range(60_000))]
    for limit in (256, 0):
        monkeypatch.setattr(pieces, "LONG_WORD", limit)
        got = own.encode_words([pieces.BLANK + w for w in words])
        assert got == [lib.encode(w) for w in words]


def test_pieces_query_form(spark, docs, empty):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = pieces.encode_texts(docs, path).collect()
    text = {i: t or "" for i, t, *_ in corpus()}
    assert len(rows) == docs.count()
    for r in rows:
        ids = lib.encode(text[r["doc_id"]])
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (",".join(map(str, ids)), len(ids), lib.decode(ids))
    assert pieces.encode_texts(empty, path).count() == 0


# 10. URLs


LINKS = [
    (1, "https://a.example.org/es/x", None),
    (2, "HTTP://EXAMPLE.COM/de/1?q#f", ""),
    (3, "http://x.net/old", '<meta http-equiv="refresh" content="0; url=http://example.com/de/2">'),
    (4, "http://x.net/older", '<link rel="canonical" href="/old">'),
    (5, "http://x.net/free", '<link rel="canonical" href="https://b.org/fine">'),
    (6, "https://badexample.org/es/", ""),
    (7, None, '<link rel="canonical" href="/x">'),
    (8, "no scheme", None),
    (9, "http://y.net/both", '<link rel="canonical" href="http://example.com/de/3">'),
    (10, "http://z.net/q", "<link rel='canonical' href='http://y.net/both'>"),
    (11, "http://w.org/ok", '<link rel="canonical" href="http://y.net/both">'),
    (1, "https://a.example.org/es/x", None),
    # dot segments, a list in rel, character references, a base
    (20, "http://x.net/a/b/c", '<link href="../.././old" rel="shortlink canonical">'),
    (21, "http://x.net/a/d", '<LINK REL=Canonical HREF="http&#58;//example.com/de/4?a=1&amp;b=2">'),
    (22, "http://t.net/p", '<base href="http://x.net/"><link rel="canonical" href="old">'),
    (23, "http://v.net/p", '<base href="http://x.net/k/"><link rel="canonical" href="../old">'),
    (24, "http://v.net/r/", '<meta content="5;URL=\'//example.com/de/../de/5\'" http-equiv=Refresh>'),
    (25, "http://v.net/?x=1", '<link rel="canonical" href="?x=2">'),
    (26, "http://v.net/?x=2", '<link rel="canonical" href="http://example.com/de/&#x36;">'),
    # no links
    (30, "http://u.net/1", '<!-- <link rel="canonical" href="http://example.com/de/2"> -->'),
    (31, "http://u.net/2", '<script>"<link rel=canonical href=http://example.com/de/2>"</script>'),
    (32, "http://u.net/3", '<link rel="canonically" href="http://example.com/de/2"><link data-rel="canonical" href="http://example.com/de/2">'),
    (33, "http://u.net/4", '<link rel="canonical" href="mailto:a@b.c"><link rel=canonical href=""><link rel="canonical'),
    (34, "https://x.net/old", '<link rel="stylesheet" href="http://example.com/de/2">'),
    (35, "http://x.net/old#top", "canonical"),
]


def test_rules_and_aliases(spark):
    pages = spark.createDataFrame([(*r, "v") for r in LINKS], "page_id long, url string, html string, verdict string")
    rules = urlrules.rules_frame(spark)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge_urls(pages, rules).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("example.com", "/de/1", "com/de/", "block")
    assert got[3][2:] == (None, "block") and got[4][2:] == (None, "block")
    assert got[5][2:] == (None, "allow") and got[6][2:] == ("org/", "allow")
    assert got[7] == got[8] == ("", "", None, "allow")
    # an explicit allow in the component keeps aliases without a rule
    assert got[9][3] == got[10][3] == "allow" and got[11][2:] == ("org/", "allow")
    assert {got[i][3] for i in range(20, 27)} == {"block"}
    assert {got[i][2:] for i in range(30, 36)} == {(None, "allow")}
    assert urlrules.judge_urls(pages.limit(0), rules).count() == 0
    loose = {r["page_id"]: r["verdict"] for r in urlrules.judge_urls(pages, rules, loose=True).collect()}
    assert loose[34] == loose[35] == "block"


def test_links_against_sql(spark):
    import duckdb
    import pandas as pd

    from marginalia.llm.queries import OP10_SQL

    pages = pd.DataFrame(LINKS, columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", pages)
    want = sorted(con.sql(OP10_SQL).fetchall(), key=str)
    df = spark.createDataFrame(LINKS, "page_id long, url string, html string")
    got = urlrules.judge_urls(df, urlrules.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == want


# Odd input for every operator

CLASHES = ("size", "shard", "slot", "uid", "piece", "start", "length", "digest", "kept", "old", "norm", "salt", "hash", "id", "key", "class_id", "tid", "block", "row", "part", "term", "n", "carried", "held_out", "score", "ids", "host", "url", "_id")


def _operators():
    return {
        "shards": lambda df: sharding.shard_by_bytes(df, 3),
        "packing": lambda df: packing.pack(df, tokenizer_file("byte_bpe_50k.json"), 2048, 0)[0],
        "exact": exactdedup.dedup_table,
        "cut": bwtdedup.dedup,
        "near": orderhash.classes,
        "prints": imatch.edited_fingerprints,
        "language": langid.identify,
        "pieces": lambda df: pieces.encode_texts(df, tokenizer_file("piece_bpe_32k.model")),
    }


@pytest.mark.parametrize("name", sorted(_operators()))
def test_long_texts_and_clashing_columns(spark, name):
    rng = random.Random(11)
    long = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(40_000))
    rows = [(1, long), (2, long), (3, long[: len(long) // 2] + " changed " + long[len(long) // 2 :]), (4, "x" * 300_000), (5, "né 日本 " * 20_000), (6, None), (7, ""), (None, "short"), (8, "short"), (8, "short")]
    df = spark.createDataFrame([(i, t, "aa") for i, t in rows], "doc_id long, text string, lang string")
    odd = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    operator = _operators()[name]
    plain = operator(df)
    keep = [c for c in plain.columns if c not in ("uid", "shard", "slot")]
    got = sorted(map(str, operator(odd).select(keep).collect()))
    assert got == sorted(map(str, plain.select(keep).collect()))
    assert len(got) == len(rows) or name == "packing"
    if name == "near":
        of = {r["doc_id"]: r["class_id"] for r in plain.collect()}
        assert of[1] == of[2] == of[3] == 1 and of[4] == 4
    if name == "cut":
        left = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in plain.collect()}
        assert left[1] == len(long) and left[2] == 0 and left[3] < 200


def test_links_around_the_threshold(spark):
    """All links of families whose members are more or less alike."""
    rng = random.Random(12)
    rows = []
    for family in range(40):
        base = [f"{rng.choice(WORDS)}{rng.randint(0, 999)}" for _ in range(250)]
        for k in range(6):
            words = list(base)
            for _ in range(rng.randint(1, 9)):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
            rows.append((family * 100 + k, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in orderhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seqs = {i: orderhash.shingles(orderhash.word_hashes(t)) for i, t in rows}
    ids = sorted(seqs)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if a // 100 == b // 100 and orderhash.similarity(seqs[a], seqs[b]) >= 0.8]
    assert len(links) > 100 and np.mean([got[a] == got[b] for a, b in links]) == 1.0
    # and no class is larger than what links make
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        top[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in ids}


# The subpackage


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for path in glob.glob(f"{root}/marginalia/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", open(path).read()), path


def test_pipeline_stages(spark):
    import corpus_pipeline

    df = spark.createDataFrame([r[:5] for r in corpus()], "doc_id long, text string, lang string, source string, n_chars long")
    before = df.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = common.Scratch(spark).save(stage(spark, df, None))
        assert tuple(df.columns) == corpus_pipeline.COLUMNS
        assert df.count() <= before
        before = df.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, df, None).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in df.collect()}
    gone = corpus_pipeline.identify_language(spark, df.limit(0), None)
    assert gone.count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import tokenizers

    rng = random.Random(21)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(3, 8)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = [(i, text(lang, rng.randint(20, 400)), lang) for i in range(60) for lang in [rng.choice(list(letters))]]
    passage = text("aa", 14)
    rows += [(100 + i, f"{text('aa', 50)} {passage} {text('aa', 50)}", "aa") for i in range(5)]
    rows += [(200 + i, rows[i][1].upper() if i % 2 else rows[i][1], rows[i][2]) for i in range(8)]
    rows += [(300 + i, f"{rows[i][1]} {word('aa')}", "aa") for i in range(10, 18)]
    rows += [(400, "", "aa"), (401, None, "aa"), (402, "123 !", "bb"), (403, text("aa", 4000), None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))

    def left(rows):
        return sorted((i, t) for i, t in rows)

    # languages: fewest phrases of the longest matches, weighed by what a phrase costs
    sample = langid.labelled_sample(df)
    parser = langid.CrossParser(sample)
    count, has = parser.phrases([t or "" for _, t, _ in rows])
    bits = count * np.array(parser.cost)[:, None]
    share = 1 / (2.0 ** -np.minimum(bits - bits.min(axis=0), 1000)).sum(axis=0)
    want = [(i, t) for (i, t, _), ok in zip(rows, has & (share >= corpus_pipeline.MIN_SCORE), strict=True) if ok]
    steps = [left(want)]
    # exact copies: the largest doc_id of each text
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    largest = {}
    for i, t in want:
        largest[lower(t)] = max(largest.get(lower(t), i), i)
    want = [(i, t) for i, t in want if largest[lower(t)] == i]
    steps.append(left(want))
    # near copies: the smallest doc_id of each component
    seqs, top = {i: orderhash.shingles(orderhash.word_hashes(t)) for i, t in want}, {i: i for i, _ in want}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in seqs:
        for b in seqs:
            if a < b and orderhash.similarity(seqs[a], seqs[b]) >= 0.8:
                top[max(find(a), find(b))] = min(find(a), find(b))
    want = [(i, t) for i, t in want if find(i) == i]
    steps.append(left(want))
    want = [(int(i), kept.decode()) for i, _, _, _, kept in brute_force_cut(want) if kept]
    steps.append(left(want))

    docs, ids = corpus_pipeline.read(spark, str(tmp_path), "documents"), tokenizers.Tokenizer.from_file(str(tokenizer_file("byte_bpe_50k.json")))
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        docs = common.Scratch(spark).save(stage(spark, docs, str(tmp_path)))
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == expected, name
    assert len({len(s) for s in steps}) > 2 and sum(len(t) for _, t in steps[3]) < sum(len(t) for _, t in steps[2])

    import base64

    packed, room, pieces_of = corpus_pipeline.run(spark, str(tmp_path)).collect(), {}, {}
    for r in packed:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces_of.setdefault(r["doc_id"], []).append((r["piece"], r["start"], np.frombuffer(base64.b64decode(r["ids"]), "<u4").tolist()))
    for spans in room.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    for i, t in steps[3]:
        mine = sorted(pieces_of.pop(i))
        assert [x for _, _, part in mine for x in part] == [*ids.encode(t, add_special_tokens=False).ids, 0]
    assert not pieces_of
