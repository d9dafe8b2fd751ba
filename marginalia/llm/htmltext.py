"""Main text of web pages by a suffix array per host.

1. A page is read into blocks of text.  What HTML itself says is kept with
   each block: it lies in an ``article`` or ``main`` element, in an element or
   ARIA role that is no article text (menus, headers, footers, ...), or
   neither.
2. The token streams of a host's distinct pages, menus and footers included,
   are concatenated, and a suffix array finds the long runs that several of
   the pages share.  A large host is dealt into groups of bounded size; runs
   are then counted over the whole host by their hashes.
3. What these runs cover is removed.  Outside ``article`` and ``main`` a run
   counts from ``RUN_PAGES`` pages on; inside, where articles quote each
   other, only if most of the host's pages have it.  The unique rest is the
   text: that of ``article`` and ``main`` if the page has any, else of all
   blocks that HTML doesn't rule out.
"""

from __future__ import annotations

import html
import json
import re

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .urlrules import host_of

#: Tokens of a repeated run, and distinct pages of the host that share it.
RUN_TOKENS, RUN_PAGES = 8, 3
#: Inside ``article`` and ``main``: so many pages and more than this share of the host's.
ARTICLE_PAGES, ARTICLE_SHARE = 8, 0.5
#: A page of whose text more than this share is shared is a copy of other pages and keeps it.
COPY_SHARE = 0.8
#: Bytes of html of a group.  They bound memory, not the decision: larger hosts are
#: dealt into groups, and a host's groups add up.
GROUP_BYTES = 8 << 20
#: Large hosts up to that number are broadcast; more are joined.
BROADCAST_HOSTS = 100_000

# Names of HTML elements and ARIA roles by what the standards say of them.
_RAW = {"script", "style", "textarea", "template", "noscript", "iframe", "title", "svg", "math", "object", "select"}
_NEVER = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "label"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "comment", "note"}
#: Whole class or id tokens that authors give to what is no article.
LABELS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "comments", "comment-list", "sidebar", "breadcrumb", "breadcrumbs", "navbar", "cookie-banner", "cookie-notice"}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"(?<![^\s\"'])(class|id|role|hidden|aria-hidden|itemprop)(?![^\s=/>])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: Where a block lies: in the article, ruled out, or neither.
INSIDE, RULED_OUT, OUTSIDE = "a", "x", "o"


def _unwanted(tag: str, attrs: str) -> bool:
    if tag in _NEVER:
        return True
    if not attrs.strip() or tag in ("body", "html", "main"):
        return False
    for name, *values in _ATTR.findall(attrs):
        value, name = "".join(values).lower(), name.lower()
        if (
            name == "role"
            and value in _ROLES
            or name in ("class", "id")
            and not LABELS.isdisjoint(value.split())
            or name == "itemprop"
            and value == "comment"
            or name == "hidden"
            and value != "until-found"
            or name == "aria-hidden"
            and value == "true"
        ):
            return True
    return False


def blocks_of(page: str) -> list[tuple[str, str]]:
    """The page's blocks of text in order, each with where it lies.

    An ``article`` within an ``article`` is a comment or another entry, as
    HTML has it, and ruled out.  The headings of a ``header`` in an article
    are its title and count as text."""
    out: list[tuple[str, str]] = []
    text: list[str] = []
    # skip: the element that rules out what it holds; nested: how many of its name are open
    depth, articles, skip, nested, heading, at, end = 0, 0, "", 0, "", 0, len(page)

    def close():
        words = html.unescape("".join(text)).split()
        text.clear()
        if words:
            out.append((RULED_OUT if skip and not heading else INSIDE if depth else OUTSIDE, " ".join(words)))

    while at < end:
        m = _TAG.search(page, at)
        text.append(page[at : m.start() if m else end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if not closing and tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            text.append(" ")
        elif tag == "br":
            text.append(" ")
        elif skip:
            if tag in _INLINE and tag != skip:
                continue
            close()
            if heading:
                heading = "" if tag == heading and closing else heading
            elif tag == skip:
                nested += -1 if closing else 0 if attrs.endswith("/") else 1
                skip = skip if nested else ""
            elif closing and tag in ("article", "main", "body") and depth:
                skip, depth = "", depth - 1  # an element that was never closed ends with what holds it
                articles -= tag == "article"
            elif skip == "header" and depth and tag in _HEADINGS and not closing:
                heading = tag
        elif not closing and tag not in _VOID and (_unwanted(tag, attrs) or tag == "article" and articles > 0):
            close()
            skip, nested = tag, 1
        elif tag in ("article", "main"):
            close()
            depth = max(0, depth + (-1 if closing else 1))
            if tag == "article":
                articles = max(0, articles + (-1 if closing else 1))
        elif tag not in _INLINE:
            close()
    close()
    return out


def shared_runs(tokens: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all runs of ``RUN_TOKENS`` in the order of a suffix array,
    the interval of equal runs each start belongs to, and the distinct pages
    of each interval.

    The suffix array is sorted as deep as the run: by doubling, ranks of k
    tokens give those of 2k, and equal ranks at that depth are the intervals
    of repeated runs.  ``page`` must ascend; no run crosses pages."""
    n, none = len(tokens), np.array([], np.int64)
    if n < RUN_TOKENS:
        return none, none, none
    rank, k = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while k < RUN_TOKENS:
        step = min(k, RUN_TOKENS - k)
        ahead = np.full(n, -1, np.int64)
        ahead[:-step] = rank[step:]
        rank = np.unique(rank * (n + 2) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        k += step
    whole = np.zeros(n, bool)
    whole[: n - RUN_TOKENS + 1] = page[RUN_TOKENS - 1 :] == page[: n - RUN_TOKENS + 1]
    sa = np.flatnonzero(whole)
    sa = sa[np.argsort(rank[sa], kind="stable")]
    if not len(sa):
        return none, none, none
    head = np.r_[True, rank[sa[1:]] != rank[sa[:-1]]]
    new_page = head | np.r_[True, page[sa[1:]] != page[sa[:-1]]]  # positions of an interval ascend, so do pages
    interval = np.cumsum(head) - 1
    return sa, interval, np.bincount(interval[new_page])


def covered(n: int, start: np.ndarray) -> np.ndarray:
    """Which of n tokens the runs that begin at ``start`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + RUN_TOKENS, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(tokens: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Tokens covered by a run of ``RUN_TOKENS`` that ``RUN_PAGES`` pages share."""
    sa, interval, pages = shared_runs(tokens, page)
    return covered(len(tokens), sa[pages[interval] >= RUN_PAGES] if len(sa) else sa)


def kind_of_run(pages: np.ndarray, of_host: int) -> np.ndarray:
    """0: unique enough; 1: boilerplate outside articles; 2: inside them too."""
    inside = (pages >= max(RUN_PAGES, ARTICLE_PAGES)) & (pages > ARTICLE_SHARE * of_host)
    return np.where(inside, 2, (pages >= RUN_PAGES).astype(np.int64))


#: Between the blocks of a page; white space, so no word holds it.
_CUT = "\x1e"


class Group:
    """Distinct pages of a host, their token streams one after the other."""

    def __init__(self, bodies):
        unpack = zstandard.ZstdDecompressor()
        parts = [json.loads(unpack.decompress(b)) for b in bodies]
        self.rows = [row for p in parts for row in zip(*p, strict=True)]  # page_id, url, stream
        self.streams = list({s: None for _, _, s in self.rows})
        self.blocks = [[(b[0], b[1:].split()) for b in s.split(_CUT)] if s else [] for s in self.streams]
        words = [w for p in self.blocks for _, b in p for w in b]
        self.size = [sum(len(b) for _, b in p) for p in self.blocks]
        self.page = np.repeat(np.arange(len(self.streams)), self.size)
        codes, names = pd.factorize(np.array(words, object)) if words else (np.array([], np.int64), [])
        self.tokens, self.names = codes.astype(np.int64), names
        self.sa, self.interval, self.pages = shared_runs(self.tokens, self.page)

    def run_hashes(self) -> np.ndarray:
        """Hash of the run of each interval, the same in every group."""
        if not len(self.sa):
            return np.array([], np.uint64)
        word = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.names], np.uint64)[self.tokens]
        first = self.sa[np.flatnonzero(np.r_[True, self.interval[1:] != self.interval[:-1]])]
        h = np.zeros(len(first), np.uint64)
        for i in range(RUN_TOKENS):
            h = (h ^ word[first + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def texts(self, kind: np.ndarray) -> pd.DataFrame:
        """Every page's text, given each interval's kind."""
        per = kind[self.interval] if len(self.sa) else self.sa
        cover = [covered(len(self.tokens), self.sa[per >= least]) if len(self.sa) else np.zeros(len(self.tokens), bool) for least in (1, 2)]
        out, at = {}, 0
        for stream, blocks, size in zip(self.streams, self.blocks, self.size, strict=True):
            shared, wide = cover[0][at : at + size], cover[1][at : at + size]
            at += size
            place = np.repeat([b[0] for b in blocks], [len(b[1]) for b in blocks]) if blocks else np.array([], str)
            inside = place == INSIDE
            mine, gone = (inside, wide) if inside.any() else (place == OUTSIDE, shared)
            if gone[mine].sum() > COPY_SHARE * mine.sum():
                gone = np.zeros(size, bool)
            stay = mine & ~gone
            if stay.all():
                text = " ".join(w for _, b in blocks for w in b)
            else:
                words = [w for _, b in blocks for w in b]
                text = " ".join([words[i] for i in np.flatnonzero(stay).tolist()])
            out[stream] = text, int((shared & ~stay).sum())
        return pd.DataFrame([(i, u, *out[s]) for i, u, s in self.rows], columns=["page_id", "url", "text", "removed_tokens"]).astype({"page_id": "Int64"})


def pack(pages: DataFrame) -> DataFrame:
    """(host, parts, part, body): read pages, in compressed parcels.

    ``pages``: page_id, url, html, host, parts.  Pages of one stream of text
    go to the same part."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            found: dict[tuple, list] = {}
            for i, u, h, host, parts in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["host"], pdf["parts"].tolist(), strict=True):
                stream = _CUT.join([place + b for place, b in blocks_of(h)])
                part = xxhash.xxh3_64_intdigest(stream.encode("utf-8", "surrogatepass")) % parts if parts > 1 else 0
                found.setdefault((host, parts, part), []).append((None if pd.isna(i) else int(i), u, stream))
            rows = [(*key, press.compress(json.dumps(list(zip(*rows, strict=True))).encode())) for key, rows in found.items()]
            yield pd.DataFrame(rows, columns=["host", "parts", "part", "body"])

    return pages.mapInPandas(run, "host string, parts long, part long, body binary")


_TEXTS = "page_id long, url string, text string, removed_tokens long"


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, removed_tokens (tokens
    that shared runs cover and that are not in the text).

    ``pages``: page_id, url, html.  Character references are decoded, white
    space in a block becomes one space, blocks are joined by one space.  Null
    html counts as empty and gives an empty text; a page with a null or odd
    url belongs to the empty host; repeated rows are each returned; pages of
    the same text count as one; an empty table gives an empty one; other
    columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    large = given.groupBy("host").agg(F.sum(F.octet_length("html")).alias("n")).where(F.col("n") > GROUP_BYTES)
    large = scratch.save(large.select("host", F.ceil(F.col("n") / GROUP_BYTES).alias("parts")))
    known = large.count()

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Group(pdf["body"])
        return g.texts(kind_of_run(g.pages, len(g.streams)))

    sized = F.broadcast(large) if known <= BROADCAST_HOSTS else large.hint("merge")
    small = given.join(sized, "host", "left_anti") if known else given
    out = pack(small.withColumn("parts", F.lit(1).cast("long"))).groupBy("host").applyInPandas(alone, _TEXTS)
    if not known:
        return out

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Group(pdf["body"])
        host, parts, part = pdf["host"].iloc[0], int(pdf["parts"].iloc[0]), int(pdf["part"].iloc[0])
        runs = g.run_hashes()
        home = (runs % np.uint64(parts)).astype(np.int64)
        return pd.DataFrame(
            [(host, b, part, len(g.streams), runs[home == b].tobytes(), g.pages[home == b].astype(np.uint32).tobytes()) for b in range(parts)],
            columns=["host", "bucket", "part", "pages", "runs", "n"],
        )

    def tally(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(r, np.uint64) for r in pdf["runs"]]
        run, at = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.frombuffer(n, np.uint32) for n in pdf["n"]]), len(run))
        kind = kind_of_run(total, int(pdf["pages"].sum()))[at].astype(np.uint8)  # each part has one row
        rows, end = [], 0
        for part, runs in zip(pdf["part"], own, strict=True):
            mine = kind[end : end + len(runs)]
            end += len(runs)
            rows.append((pdf["host"].iloc[0], part, runs[mine > 0].tobytes(), mine[mine > 0].tobytes()))
        return pd.DataFrame(rows, columns=["host", "part", "runs", "kinds"])

    def prune(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        g = Group(pdf["body"])
        runs, kinds = (np.frombuffer(b"".join(told[c]), t) for c, t in (("runs", np.uint64), ("kinds", np.uint8)))
        by = np.argsort(runs)
        mine, kind = g.run_hashes(), np.zeros(len(g.pages), np.int64)
        if len(runs) and len(mine):
            at = by[np.minimum(np.searchsorted(runs, mine, sorter=by), len(runs) - 1)]
            kind = np.where(runs[at] == mine, kinds[at], 0)
        return g.texts(kind)

    packed = pack(given.join(sized, "host"))
    counted = packed.groupBy("host", "part").applyInPandas(count, "host string, bucket long, part long, pages long, runs binary, n binary")
    told = scratch.save(counted.groupBy("host", "bucket").applyInPandas(tally, "host string, part long, runs binary, kinds binary"))
    pruned = packed.groupBy("host", "part").cogroup(told.groupBy("host", "part")).applyInPandas(prune, _TEXTS)
    return out.unionByName(pruned)
