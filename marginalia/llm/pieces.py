"""Encoding and decoding with a SentencePiece BPE model.

All words of a batch that are not known yet are encoded together: flat numpy
arrays hold their symbols, each round finds every word's best-ranked pair by a
segmented minimum, merges its occurrences from the left at once and closes the
gaps, until no word has a pair left.  Long words, whose rounds would cost their
square, go through the pairs in the order of their ranks instead: a round
merges all occurrences of the best pair left in any of them, and only what lies
beside a merge is looked up again.  Merges never cross from a word into the
next run of blanks, because no piece has a blank after another character.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

BLANK = "▁"
#: Words whose pieces a worker keeps.
CACHE_WORDS = 500_000
#: Words of more characters are merged in rounds by rank.
LONG_WORD = 256

_RUNS = re.compile(" +[^ ]*")
_NONE = np.int64(2**62)


class PieceBpe:
    """A BPE model with byte fallback, dummy prefix and no normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(" ﬁ  ") != f"{BLANK}{BLANK}ﬁ{BLANK}{BLANK}":
            raise ValueError("only models without normalisation and with a dummy prefix are supported")
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(BLANK in self.pieces[i].lstrip(BLANK) for i in normal):
            raise ValueError("a piece has a blank after another character")
        # what a normal piece decodes to, and each id as it is written
        self.text_of: list[str | None] = [None] * size
        for i in normal:
            self.text_of[i] = self.pieces[i].replace(BLANK, " ")
        self.written = [str(i) for i in range(size)]
        symbol = {self.pieces[i]: i for i in normal}
        for c in sorted(set("".join(symbol))):
            symbol.setdefault(c, size + len(symbol))
        self.n_symbols = 1 + max(symbol.values())
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        levels = {v: r for r, v in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        rows = []
        for i in normal:
            s = self.pieces[i]
            for k in range(1, len(s)):
                if s[:k] in symbol and s[k:] in symbol:
                    rows.append((symbol[s[:k]] * self.n_symbols + symbol[s[k:]], levels[sp.get_score(i)], i))
        rows.sort()
        self.pair_key, self.pair_rank, self.pair_to = (np.array([r[k] for r in rows], np.int64) for k in range(3))

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and index of each pair; no pair: a rank of _NONE."""
        key = np.where((left >= 0) & (right >= 0), left * self.n_symbols + right, -1)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NONE), at

    def _ids(self, symbols, codes) -> list[int]:
        """Symbols that are no piece become the bytes of their character."""
        size, out = len(self.pieces), []
        for s, c in zip(symbols, codes, strict=True):
            if 0 <= s < size:
                out.append(s)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def _chosen(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray, right: np.ndarray, rank: np.ndarray, to: np.ndarray, sides_of) -> np.ndarray:
        """Which of the ascending places ``at`` of a word's best pair merge now.

        Not those whose left symbol the place before takes.  If a merge makes
        a pair of the same or a better rank, which one by one would come next,
        the word's later places wait.  ``right``: the places of the pair's
        right symbol; ``sides_of``: those of its neighbours, or -1."""
        same = owner[1:] == owner[:-1]
        lone = ~(np.r_[False, same] | np.r_[same, False])
        if lone.all():
            return lone
        many = np.flatnonzero(~lone)
        at, right, owner, rank, to = at[many], right[many], owner[many], rank[many], to[many]
        before, beyond = sides_of(at)
        first = np.flatnonzero(np.r_[True, at[1:] != right[:-1]])
        keep = np.flatnonzero((np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))) % 2 == 0)
        made, beside = to[keep], np.r_[False, before[keep[1:]] == right[keep[:-1]]]
        sides = [(np.where(before[keep] >= 0, sym[before[keep]], -1), made), (made, np.where(beyond[keep] >= 0, sym[beyond[keep]], -1)), (np.where(beside, np.r_[-1, made[:-1]], -1), made)]
        early = np.logical_or.reduce([self._look_up(x, y)[0] <= rank[keep] for x, y in sides]).astype(np.int64)
        word = np.r_[True, owner[keep[1:]] != owner[keep[:-1]]]
        met = np.cumsum(early) - early
        begin = np.flatnonzero(word)
        now = met == np.repeat(met[begin], np.diff(np.r_[begin, len(keep)]))
        lone[many[keep[now]]] = True
        return lone

    def _long(self, words: list[str]) -> list[list[int]]:
        """Rounds by rank: the places of each rank wait until it is the best."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in words])
        owner, ends, n = np.repeat(np.arange(len(words)), lengths), np.cumsum(lengths), len(code)
        sym, nxt, prev, live = self.of_char[code], np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        nxt[ends - 1] = prev[ends - lengths] = -1
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def offer(at):
            at = at[nxt[at] >= 0]
            rank, _ = self._look_up(sym[at], sym[nxt[at]])
            at, rank = at[rank != _NONE], rank[rank != _NONE]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            if not len(at):
                return
            cut = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
                r = int(rank[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(at[a:b])

        offer(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[live[at] & (nxt[at] >= 0)]
            rank, row = self._look_up(sym[at], sym[nxt[at]])
            at, to = at[rank == r], self.pair_to[row[rank == r]]
            if not len(at):
                continue
            after = nxt[at]
            now = self._chosen(sym, owner[at], at, after, np.full(len(at), r), to, lambda p: (prev[p], nxt[nxt[p]]))
            left, to, later = at[now], to[now], at[~now]
            gone = nxt[left]
            sym[left], live[gone], nxt[left] = to, False, nxt[gone]
            far = nxt[left] >= 0
            prev[nxt[left[far]]] = left[far]
            before = prev[left]
            offer(np.unique(np.concatenate([before[before >= 0], left, later[live[later]]])))
        sym, code, owner = sym[live], code[live], owner[live]
        stops = np.searchsorted(owner, np.arange(len(words)), "right")
        return [self._ids(sym[a:b].tolist(), code[a:b].tolist()) for a, b in zip([0, *stops], stops, strict=False)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; a word is a run of blank signs and what follows."""
        out: list[list[int]] = [[]] * len(words)
        short = [k for k, w in enumerate(words) if 0 < len(w) <= LONG_WORD]
        long = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
        for k, ids in zip(long, self._long([words[k] for k in long]) if long else [], strict=True):
            out[k] = ids
        if not short:
            return out
        code = np.frombuffer("".join(words[k] for k in short).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(short)), [len(words[k]) for k in short])
        sym, done = self.of_char[code], []
        while len(sym):
            rank = np.full(len(sym), _NONE)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner], at = self._look_up(sym[inner], sym[inner + 1])
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[start, len(sym)])
            best = np.minimum.reduceat(rank, start)
            each = np.repeat(best, length)
            over = each == _NONE
            done.append((owner[over], sym[over], code[over]))
            hit = np.flatnonzero((rank == each) & ~over)
            if not len(hit):
                break

            def sides(p, owner=owner):
                beyond = np.minimum(p + 2, len(owner) - 1)
                ends = (beyond != p + 2) | (owner[beyond] != owner[p])
                return np.where((p > 0) & (owner[p - 1] == owner[p]), p - 1, -1), np.where(ends, -1, beyond)

            to = np.zeros(len(sym), np.int64)
            to[inner] = self.pair_to[at]
            hit = hit[self._chosen(sym, owner[hit], hit, hit + 1, rank[hit], to[hit], sides)]
            sym[hit] = to[hit]
            stay = ~over
            stay[hit + 1] = False
            owner, sym, code = owner[stay], sym[stay], code[stay]
        owner, sym, code = (np.concatenate([d[i] for d in done]) for i in range(3))
        order = np.argsort(owner, kind="stable")
        owner, sym, code = owner[order], sym[order], code[order]
        odd = np.zeros(len(short), bool)
        odd[owner[(sym < 0) | (sym >= len(self.pieces))]] = True
        ends = np.searchsorted(owner, np.arange(len(short)), "right").tolist()
        sym, code, a = sym.tolist(), code.tolist(), 0
        for k, b, unknown in zip(short, ends, odd.tolist(), strict=True):
            out[k] = self._ids(sym[a:b], code[a:b]) if unknown else sym[a:b]
            a = b
        return out

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; bytes that form no character become U+FFFD each."""
        known = [self.text_of[i] for i in ids]
        if None not in known:
            text = "".join(known)
            return text[1:] if first and text[:1] == " " else text
        out, run = [], bytearray()

        def flush():
            i = 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + n]).decode("utf-8"))
                        i += n
                        break
                    except UnicodeDecodeError:
                        if n == 4 or i + n >= len(run):
                            out.append("�")
                            i += 1
                            break
            run.clear()

        for k, i in enumerate(ids):
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            flush()
            if i in self.silent:
                continue
            s = " ⁇ " if i == self.unknown else self.pieces[i]
            if first and k == 0 and s.startswith(BLANK):
                s = s[1:]
            out.append(s.replace(BLANK, " "))
        flush()
        return "".join(out)


def words_of(text: str) -> list[str]:
    """Keys of a text's words.  A key lacks the word's first blank."""
    text = text.replace(BLANK, " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    return [w[1:] for w in _RUNS.findall(" " + text)] if text else []


class _Known:
    """Per word: ids as decimals joined by commas, their number, their text."""

    def __init__(self, model: PieceBpe):
        self.model, self.words = model, {}

    def learn(self, wanted: set[str]) -> None:
        new = [w for w in wanted if w not in self.words]
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words = {}
            new = list(wanted)
        written = self.model.written
        for w, ids in zip(new, self.model.encode_words([BLANK + w.replace(" ", BLANK) for w in new]), strict=True):
            self.words[w] = (",".join([written[i] for i in ids]), len(ids), self.model.decode(ids, first=False))


def encode_texts(documents: DataFrame, model: str, batch: int = 1000) -> DataFrame:
    """Ids of each whole text and what they decode to.

    Equal to the library's ``encode`` without begin and end ids and its
    ``decode``.  Returns doc_id, ids (decimals joined by commas), n_tokens,
    decoded.  Null text counts as empty and has no ids; a null doc_id stays;
    repeated rows are each returned; columns beside doc_id and text are
    ignored; an empty table gives an empty one.
    """

    def run(batches):
        kept = worker_cache("piece_bpe")
        if model not in kept:
            kept[model] = _Known(PieceBpe(model))
        known = kept[model]
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                words = [words_of(t) for t in part["text"]]
                known.learn(set(chain.from_iterable(words)))
                rows = [[known.words[w] for w in ws] for ws in words]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64"),
                        "ids": [",".join([e[0] for e in es]) for es in rows],
                        "n_tokens": [sum([e[1] for e in es]) for es in rows],
                        "decoded": ["".join([e[2] for e in es])[1:] for es in rows],
                    }
                )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInPandas(run, "doc_id long, ids string, n_tokens long, decoded string")
