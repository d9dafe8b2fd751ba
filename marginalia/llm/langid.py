"""Language identification by cross-parsing.

For each language a suffix automaton of a bounded sample of labelled text is
built.  A text is parsed into the longest phrases that each automaton knows;
the language whose phrases, weighted by what it costs to name one, are fewest
wins.  Texts are cut into pieces that a batch parses in step with numpy, each
as if a phrase began with it; where one doesn't, the parse of the piece before
goes on until both agree, so the count is that of the whole text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

#: Bounds of the labelled sample, for each language: rows asked for, characters kept in all and of one row.
SAMPLE_ROWS, SAMPLE_CHARS, ROW_CHARS = 160, 40_000, 800
#: Most frequent letters of a language that its automaton tells apart; any others
#: are coded by their code point modulo ``CLASSES``.
LETTERS, CLASSES = 44, 16
#: Symbols of one piece.
WINDOW = 256

SPACE = 0


def held_out(doc_id):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(documents: DataFrame) -> dict[str, list[str]]:
    """At most about ``SAMPLE_ROWS`` texts of each language, chosen by a hash
    of text among rows that are not held out, in the order of that hash."""
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = F.lit(0).cast("long")
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(2**63 - 1, 2**63 * SAMPLE_ROWS // n))).otherwise(share)
    h = F.xxhash64("text", F.lit(7))
    picked = rows.where(h.bitwiseAND(F.lit(2**63 - 1)) <= share).select("lang", h.alias("h"), F.substring("text", 1, ROW_CHARS).alias("text")).distinct()
    found: dict[str, list] = {}
    for r in picked.collect():
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return {lang: [t for _, t in sorted(rs)] for lang, rs in sorted(found.items())}


class Letters:
    """Texts as lower-case letters; runs of anything else are one space."""

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.low = np.fromiter((ord(chr(c).lower()[0]) for c in range(0x110000)), np.uint32, 0x110000)

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points (0: space) of all texts, whose they are, and whether a
        text has a letter."""
        lengths = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), lengths)
        is_letter = self.letter[code]
        has = np.zeros(len(texts), bool)
        has[owner[is_letter]] = True
        code = np.where(is_letter, self.low[code], np.uint32(0))
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1])
        return code[keep], owner[keep], has


class Alphabet:
    """A language's symbols: its frequent letters, and classes of others."""

    def __init__(self, code: np.ndarray):
        seen, counts = np.unique(code[code > 0], return_counts=True)
        known = seen[np.lexsort((seen, -counts))][:LETTERS]
        self.of = (1 + len(known) + np.arange(0x110000) % CLASSES).astype(np.uint8)
        self.of[known] = 1 + np.arange(len(known))
        self.of[0] = SPACE
        self.pad = 1 + len(known) + CLASSES
        self.size = self.pad + 1


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of ``text``."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return nxt


class CrossParser:
    """Automata of all languages as one dense table."""

    def __init__(self, sample: dict[str, list[str]]):
        self.languages, self.letters = sorted(sample), Letters()
        self.alphabets, self.tables, self.cost = [], [], []
        for lang in self.languages:
            code, _, _ = self.letters.split([" ".join(sample[lang])[:SAMPLE_CHARS]])
            alphabet = Alphabet(code)
            text, a = alphabet.of[code].tolist(), alphabet.size
            nxt = suffix_automaton(text)
            # a phrase that ends starts the next one with the symbol that ended it: the complement of where that
            # leads; a symbol that the sample lacks is a phrase, and leads to a state of its own
            lone = len(nxt)
            table = np.empty((lone + 1, a), np.int32)
            table[:] = [~(nxt[0].get(c, lone) * a) for c in range(a)]
            table[0] = ~table[0]
            for s, out in enumerate(nxt):
                for c, t in out.items():
                    table[s, c] = t * a
            table[:, alphabet.pad] = np.arange(lone + 1) * a
            self.alphabets.append(alphabet)
            self.tables.append(table.ravel())
            self.cost.append(math.log2(max(2, len(text))))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and whether it has a letter."""
        code, owner, has = self.letters.split(texts)
        total = np.zeros((len(self.languages), len(texts)), np.int64)
        if not len(code):
            return total, has
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        at = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
        fresh = at % WINDOW == 0
        piece = np.cumsum(fresh) - 1
        whose, goes_on = owner[fresh], at[fresh] > 0
        for k, (alphabet, table) in enumerate(zip(self.alphabets, self.tables, strict=True)):
            grid = np.full((WINDOW, piece[-1] + 1), alphabet.pad, np.uint8)
            grid[at % WINDOW, piece] = alphabet.of[code]
            total[k] = np.bincount(whose, self._ends(table, grid, goes_on), len(texts)).astype(np.int64)
            total[k, owner[first]] += 1
        return total, has

    @staticmethod
    def _ends(table: np.ndarray, grid: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """Phrases that end within each piece (a column of ``grid``)."""
        states, ends = np.empty(grid.shape, np.int32), np.empty(grid.shape, np.int16)
        state, count = np.zeros(grid.shape[1], np.int32), np.zeros(grid.shape[1], np.int16)
        for r, row in enumerate(grid):
            v = table[state + row]
            sign = v >> 31
            count -= sign.astype(np.int16)
            state = v ^ sign
            states[r], ends[r] = state, count
        last, out = states[-1].copy(), ends[-1].astype(np.int64)
        todo = np.flatnonzero(goes_on)
        while len(todo):
            lanes, state, count = todo, last[todo - 1], np.zeros(len(todo), np.int64)
            was = last[todo].copy()
            last[todo], out[todo] = states[-1, todo], ends[-1, todo]
            for r in range(len(grid)):
                if not len(lanes):
                    break
                v = table[state + grid[r, lanes]]
                sign = v >> 31
                count -= sign
                state = v ^ sign
                met = state == states[r, lanes]
                if met.any():
                    out[lanes[met]] = count[met] + ends[-1, lanes[met]] - ends[r, lanes[met]]
                    lanes, state, count = lanes[~met], state[~met], count[~met]
            last[lanes], out[lanes] = state, count
            moved = todo[last[todo] != was] + 1
            moved = moved[moved < len(goes_on)]
            todo = moved[goes_on[moved]]
        return out


_FOUND = "lang_pred string, score double"


def identify(documents: DataFrame, carry: tuple[str, ...] = (), batch: int = 256) -> DataFrame:
    """Language of every whole text, learned from rows of the same table.

    ``documents``: doc_id, text, lang.  Learns from a bounded sample of rows
    with a language and whose crc32(doc_id) mod 3 is not 1; predictions see
    the text alone.  Returns doc_id, held_out, lang_pred, score.  The score is
    the share of the winner if a language weighs 2 ** -(bits to name its
    phrases).

    Null text or text without a letter, or nothing to learn from: ``und``
    with score 0.  Ties go to the first language in order.  A null doc_id
    isn't held out.  Repeated rows are each returned, an empty table gives an
    empty one.  Of the other columns those named in ``carry`` are returned
    too, with ``_given`` after a name that one of the results has.
    """
    sample = labelled_sample(documents.select("doc_id", "text", "lang"))
    name = hashlib.sha256(repr(sample).encode()).hexdigest()

    def predict(parts):
        kept = worker_cache("cross_parser")
        if name not in kept and sample:
            kept.clear()
            kept[name] = CrossParser(sample)
        for part in parts:
            texts = part.tolist()
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for at in range(0, len(texts) if sample else 0, batch):
                parser = kept[name]
                count, has = parser.phrases(texts[at : at + batch])
                bits = count * np.array(parser.cost)[:, None]
                weight = 2.0 ** -np.minimum(bits - bits.min(axis=0), 1000)
                lang[at : at + batch] = np.where(has, np.array(parser.languages, object)[bits.argmin(axis=0)], "und")
                score[at : at + batch] = np.where(has, 1 / weight.sum(axis=0), 0.0)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    # not deterministic: so no filter on its result makes it run twice
    predict.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(predict, _FOUND).asNondeterministic()
    rows = documents.select(
        F.col("doc_id").cast("long").alias("_id"), held_out(F.col("doc_id")).alias("_out"), found(F.coalesce("text", F.lit(""))).alias("_found"), F.struct(F.lit(0).alias("_"), *carry).alias("_carried")
    )
    given = [F.col("_carried")[c].alias(f"{c}_given" if c in ("doc_id", "held_out", "lang_pred", "score") else c) for c in carry]
    return rows.select(F.col("_id").alias("doc_id"), F.col("_out").alias("held_out"), "_found.lang_pred", "_found.score", *given)
