"""Sequence comparison as Arrow UDFs: what no built-in function offers.

``difflib`` of the standard library defines the results; its heuristic for
long second sequences stays on or off as each use wants it.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as D


#: Fixed value: below this ratio a changed text has diverged.
LEAST_LIKENESS = 0.80


def _struct(**fields):
    return D.StructType([D.StructField(k, v) for k, v in fields.items()])


@F.pandas_udf(D.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity; null counts as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(_struct(added=D.LongType(), first=D.StringType()))
def added_text(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Characters that a revision added, and the first run of them.  A
    revision that only appends is answered without an alignment."""
    rows = []
    for a, b in zip(old.fillna(""), new.fillna(""), strict=True):
        if b.startswith(a):
            rows.append((len(b) - len(a), b[len(a) :]))
            continue
        runs = [b[j:k] for tag, _, _, j, k in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag in ("insert", "replace")]
        rows.append((sum(map(len, runs)), next((r for r in runs if r), "")))
    return pd.DataFrame(rows, columns=["added", "first"])


#: A quote is found from this ratio on; fixed values: that, and how much longer or shorter than the quote its place may be.
LEAST_RATIO, SLACK = 0.85, 20
#: Letters of a gram, for quotes from a length on and for shorter ones; places of most shared grams that are compared.
GRAM, SHORT_GRAM, GRAM_FROM, PLACES = 4, 2, 24, 12


def _flattened(quote: str) -> re.Pattern:
    """The quote's words with any white space between them."""
    return re.compile(r"\s+".join(map(re.escape, quote.split())))


def _likeliest(body: str, quote: str) -> list[int]:
    """Offsets at which most grams of the quote lie where they should."""
    n = GRAM if len(quote) >= GRAM_FROM else min(SHORT_GRAM, len(quote))
    places: dict[str, list[int]] = {}
    for i in range(len(quote) - n + 1):
        places.setdefault(quote[i : i + n], []).append(i)
    votes = Counter(at - i for at in range(len(body) - n + 1) for i in places.get(body[at : at + n], ()))
    # an insertion or a deletion moves what follows, so near offsets vote for each other
    near = Counter({o: sum(votes.get(o + d, 0) for d in range(-3, 4)) for o in votes})
    return [o for o, _ in sorted(near.items(), key=lambda v: (-v[1], v[0]))[:PLACES]]


def find_quote(body: str, quote: str, least: float = LEAST_RATIO) -> tuple[int, int] | None:
    """Where a quote stands: as it is, with other white space, or where a
    passage of nearly its length is most like it."""
    at = body.find(quote)
    if at >= 0:
        return at, at + len(quote)
    if quote.split() and (m := _flattened(quote).search(body)):
        return m.span()
    found, matcher = (least, None), difflib.SequenceMatcher(None, "", quote)
    for start in sorted({min(max(0, o), len(body)) for o in _likeliest(body, quote)}):
        for end in range(start + max(1, len(quote) - SLACK), min(len(body), start + len(quote) + SLACK) + 1, 2):
            matcher.set_seq1(body[start:end])
            if matcher.real_quick_ratio() >= found[0] and matcher.quick_ratio() >= found[0]:
                r = matcher.ratio()
                found = (r, (start, end)) if r > found[0] or found[1] is None and r >= least else found
    return found[1]


@F.pandas_udf(_struct(start=D.IntegerType(), end=D.IntegerType()))
def locate_quote(body: pd.Series, quote: pd.Series) -> pd.DataFrame:
    found = [find_quote(b or "", q or "") or (None, None) for b, q in zip(body, quote, strict=True)]
    return pd.DataFrame(found, columns=["start", "end"]).astype("Int32")


#: From what mean a page's lines are long, how long a line counts, how many
#: such lines tell a page's width, at what quantile, and what share of it is short.
LONG_MEAN, COUNTED_FROM, LEAST_LINES, QUANTILE, SHORT_SHARE = 200, 21, 3, 0.75, 0.65
#: Fixed value: the end of a sentence.
SENTENCE_END = r"[.!?\"'”)]\s*$"


def paragraphs(raw) -> Column:
    """Wrapped lines to paragraphs, which a blank line separates.

    Pages end at a form feed or a blank line.  The lines of a page are one
    paragraph, but where the page's width can be told, a line that is short
    for it and ends a sentence ends a paragraph."""
    empty = F.array().cast("array<string>")
    pages = F.split(F.regexp_replace(F.replace(raw, F.lit("\f"), F.lit("\n\n")), r"(\s*\n){3,}", "\n\n"), "\n\n")

    def rebuilt(page):
        lines = F.transform(F.filter(F.split(page, "\n"), lambda x: F.trim(x) != ""), lambda x: F.rtrim(x))
        widths = F.array_sort(F.transform(F.filter(lines, lambda x: F.length(F.trim(x)) >= COUNTED_FROM), lambda x: F.length(x)))
        mean = F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x)) / F.size(lines)
        width = F.when((mean <= LONG_MEAN) & (F.size(widths) >= LEAST_LINES), F.get(widths, F.floor(F.size(widths) * QUANTILE).cast("int")))
        ends = lambda x: F.coalesce((F.length(x) < width * SHORT_SHARE) & x.rlike(SENTENCE_END), F.lit(False))
        joined = F.array_join(F.transform(lines, lambda x, i: F.concat(x, F.when(ends(x) & (i < F.size(lines) - 1), "\n\n").otherwise(" "))), "")
        return F.trim(F.regexp_replace(F.regexp_replace(joined, r"[^\S\n]+", " "), r" ?(\n\n) ?", "$1"))

    return F.when(raw.isNotNull(), F.array_join(F.filter(F.transform(F.coalesce(pages, empty), rebuilt), lambda p: p != ""), "\n\n"))


def tex_errors(log) -> Column:
    """Errors of a TeX log: a line that starts with ``!`` and up to five more,
    fewer if the next error comes first.  Null: none."""
    whole = F.regexp_replace(F.coalesce(log, F.lit("")), r"\R\z", "")
    return F.regexp_extract_all(whole, F.lit(r"(?m)^!.*(?:\R(?!!).*){0,5}"), F.lit(0))


@F.pandas_udf(D.StringType())
def unless_diverged(original: pd.Series, changed: pd.Series) -> pd.Series:
    """The changed text, or the original where their ratio is below 0.80."""
    return pd.Series([y if isinstance(y, str) and difflib.SequenceMatcher(None, x or "", y).ratio() >= LEAST_LIKENESS else x for x, y in zip(original, changed, strict=True)])
