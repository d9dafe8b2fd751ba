"""I-Match document fingerprints.

Terms whose document frequency lies in a band (neither rare nor common) form
the lexicon.  Each of several randomised subsets of the lexicon keeps a term by
its hash; a document's distinct terms in a subset, named by their 64-bit
hashes, are sorted and hashed together.  Subsets come in families of falling
density, each inside the one before, so that short and long documents alike
have subsets with a few of their terms.

Everything here is DataFrame code: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Band of relative document frequency, lower and upper end inclusive.
BAND = (0.002, 0.1)
#: Families of subsets, and their levels; level r keeps a term with probability 2 ** -r.
FAMILIES, LEVELS = 8, range(2, 9)
#: A lexicon of at most so many terms is broadcast; beyond it, it is joined.
BROADCAST_TERMS = 1_000_000
#: Rows for which one range of doc_id is meant, and the most quantiles taken; beyond
#: them the room between two quantiles is cut evenly.
RANGE_ROWS, QUANTILES = 1024, 4096


#: What a document's row without a term carries: its id, length, hashes, and the edited text's SHA-256 as four numbers.
_KNOWN = ("id", "n_chars", "h1", "h2", "e0", "e1", "e2", "e3")


def distinct_terms(text):
    """Distinct lower-cased runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(documents: DataFrame, n: int, scratch: Scratch, band=BAND) -> DataFrame:
    """(term, h, cells) of the terms in the band, of ``n`` documents: the
    term's hash and the subsets that keep it.

    The lower end is at least two documents.  As the band is relative, the
    lexicon has at most (mean distinct terms per document) / band[0] terms,
    whatever the number of documents.
    """
    seen = documents.select(F.explode(distinct_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # written first: else the filter on cells, which needs the term alone, would move below the count and hash every word of the corpus
    kept = scratch.save(seen.where((F.col("df") >= max(2, band[0] * n)) & (F.col("df") <= band[1] * n)).select("term"))
    cells = [f"if(xxhash64(term, {f}) & {2**r - 1} = 0, {f * len(LEVELS) + i}, null)" for f in range(FAMILIES) for i, r in enumerate(LEVELS)]
    return kept.select("term", F.xxhash64("term").alias("h"), F.expr(f"array_compact(array({', '.join(cells)}))").alias("cells")).where(F.size("cells") > 0)


def slot(cell, n, h):
    """A subset, the number of a text's terms in it and their hash, like
    ``07:2:0A1B2C3D``; null if there is none."""
    return F.when(n > 0, F.concat_ws(":", F.lpad(cell.cast("string"), 2, "0"), n.cast("string"), F.lpad(F.right(F.hex(h), F.lit(8)), 8, "0")))


def likeness(a, b):
    """Share of equal slots, 0 to 1.

    Slots that are empty on both sides don't count.  If some slots have one or
    two terms on either side, only those count: dense slots nearly always
    differ after an edit.  Texts without any slot: 1 if equal, else 0.  Null
    on either side: null.
    """
    each = lambda s, pattern, group: F.regexp_extract_all(s, F.lit(pattern), F.lit(group))
    sparse = F.size(F.array_union(each(a, r"(\d+):[12]:", 1), each(b, r"(\d+):[12]:", 1)))
    same_sparse = F.size(F.array_intersect(each(a, r"\d+:[12]:[0-9A-F]+", 0), each(b, r"\d+:[12]:[0-9A-F]+", 0)))
    full = F.size(F.array_union(each(a, r"(\d+):\d+:", 1), each(b, r"(\d+):\d+:", 1)))
    same = F.size(F.array_intersect(F.split(a, " "), F.split(b, " ")))
    return F.when(a == b, 1.0).when(a.startswith("=") | b.startswith("="), 0.0).when(sparse > 0, same_sparse / sparse).otherwise(same / full)


def range_of(column, bounds: list[int]):
    """Number of ascending ``bounds`` that are at most ``column``, found among
    some coarse bounds and then among the fine ones between two of these."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(F.lit(bounds[::step]), lambda b: b <= column))
    fine = F.size(F.filter(F.slice(F.lit(bounds), (coarse - 1) * step + 1, F.lit(step)), lambda b: b <= column))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def ranges(docs: DataFrame, n: int):
    """(coarse, part) of ``id`` as columns: ascending ranges of about
    ``RANGE_ROWS`` rows each, however many there are."""
    many = max(1, n // RANGE_ROWS)
    taken = min(many, QUANTILES)
    if taken == 1:
        return F.lit(0), F.lit(0).cast("long")
    found = docs.agg(F.percentile_approx("id", [i / taken for i in range(1, taken)], 100 * taken).alias("q"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    bounds = sorted(set(found["q"]))
    coarse = range_of(F.col("id"), bounds)
    fine = -(-many // taken)
    if fine == 1:
        return coarse, coarse.cast("long")
    edges = F.lit([float(x) for x in (found["low"], *bounds, found["high"])])
    low, high = F.get(edges, coarse), F.get(edges, coarse + 1)
    inside = F.floor((F.col("id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * fine)
    return coarse, coarse.cast("long") * fine + F.least(F.greatest(inside, F.lit(0)), F.lit(fine - 1))


def following(parts: DataFrame) -> DataFrame:
    """(part, next) of the ranges (coarse, part) that have rows; the first
    follows the last.  The one window without a partition has a row per
    quantile."""
    heads = parts.groupBy("coarse").agg(F.min("part").alias("head"))
    every = Window.orderBy("coarse")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("coarse", F.coalesce(F.lead("head").over(every), F.first("head").over(whole)).alias("after"))
    inner = parts.select("coarse", "part", F.lead("part").over(Window.partitionBy("coarse").orderBy("part")).alias("within"))
    return inner.join(F.broadcast(heads), "coarse").select("part", F.coalesce("within", "after").alias("next"))


def edited_fingerprints(documents: DataFrame, band=BAND) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    Edited: the last floor(n_chars / 4) code points give way to the first as
    many (or all) of the next document in ascending doc_id, the first after
    the last.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Whole texts move once, to ranges of doc_id, and what follows stays there;
    between ranges only their first rows move.

    Null text counts as empty; a null doc_id comes first.  Rows with one
    doc_id follow each other in the order of their texts' SHA-256.  A lone
    document is its own next one.  An empty table gives an empty one.  Other
    columns are ignored.
    """
    scratch = Scratch(documents.sparkSession)
    docs = documents.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    words = scratch.save(lexicon(docs, n, scratch, band))
    small = words.count() <= BROADCAST_TERMS
    coarse, part = ranges(docs, n)
    ranged = docs.select("id", F.sha2("text", 256).alias("sha"), "text", part.alias("part"), coarse.alias("coarse"))
    key = F.struct("id", "sha")
    # the first text of each range, and how much of it the last row before it takes: a row per range
    firsts = ranged.groupBy("part").agg(F.min_by("text", key).alias("first_text"), F.max_by(F.length("text"), key).alias("n_last"), F.first("coarse").alias("coarse"))
    firsts = scratch.save(firsts)
    after = scratch.save(following(firsts.select("coarse", "part")))
    lent = firsts.select("part", "n_last").join(after, "part").join(firsts.select(F.col("part").alias("next"), "first_text"), "next")
    ends = scratch.save(lent.select("part", F.substring("first_text", F.lit(1), F.floor(F.col("n_last") / 4).cast("int")).alias("after")))
    w = Window.partitionBy("part").orderBy("id", "sha")
    quarter = F.floor(F.length("text") / 4).cast("int")
    lent = F.coalesce(F.substring(F.lead("text").over(w), F.lit(1), quarter), F.col("after"))
    rows = ranged.join(ends, "part").select("part", "id", "sha", "text", F.row_number().over(w).alias("row"), lent.alias("lent"))
    both = rows.select("part", "id", "row", "text", F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), "lent").alias("edited"))
    sets = both.select("part", "row", "id", "text", "edited", distinct_terms(F.col("text")).alias("a"), distinct_terms(F.col("edited")).alias("b")).select(
        "part", "row", "id", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("h1"), F.xxhash64("edited").alias("h2"), F.sha2("edited", 256).alias("sha"),
        F.array_intersect("a", "b").alias("t3"), F.array_except("a", "b").alias("t1"), F.array_except("b", "a").alias("t2"), F.array(F.lit(None).cast("string")).alias("t0"),
    )
    # bit 0: in the text, bit 1: in the edited one; one more row, without a term, carries what is known of the document
    sets = sets.select("part", "row", *_KNOWN[:4], *[F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long").alias(f"e{i}") for i in range(4)], F.explode(F.array(*[F.struct(F.lit(i).alias("bits"), F.col(f"t{i}").alias("ts")) for i in range(4)])).alias("g"))
    # one column and one key: what is sorted below has a row per term and subset
    spread = sets.select("part", "row", F.when(F.col("g.bits") == 0, F.struct(*_KNOWN)).alias("known"), F.col("g.bits").alias("bits"), F.explode("g.ts").alias("term"))
    hits = spread.join(F.broadcast(words) if small else words, "term", "left").where("cells is not null or bits = 0")
    hits = hits.select("part", "row", "known", "bits", "h", F.explode_outer("cells").alias("cell"))
    inside = [F.col("bits").bitwiseAND(F.lit(bit)) != 0 for bit in (1, 2)]
    cells = hits.groupBy("part", "row", "cell").agg(
        F.first("known", True).alias("known"),
        *[F.xxhash64(F.array_sort(F.collect_list(F.when(x, F.col("h"))))).alias(f"x{i}") for i, x in enumerate(inside)],
        *[F.count(F.when(x, 1)).alias(f"n{i}") for i, x in enumerate(inside)],
    )
    printed_slots = cells.select("part", "row", "known", *[slot(F.col("cell"), F.col(f"n{i}"), F.col(f"x{i}")).alias(f"s{i}") for i in range(2)])
    per = printed_slots.groupBy("part", "row").agg(F.first("known", True).alias("known"), *[F.array_join(F.array_sort(F.collect_list(f"s{i}")), " ").alias(f"s{i}") for i in range(2)]).select("part", "row", "known.*", "s0", "s1")
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"e{i}"), 16, "0") for i in range(4)]))
    whole_text = lambda s, h: F.when(F.col(s) == "", F.concat(F.lit("="), F.hex(h))).otherwise(F.col(s))
    printed = scratch.save(
        per.select("part", "row", "id", "n_chars", sha.alias("edited_sha256"), whole_text("s0", "h1").alias("fingerprint"), whole_text("s1", "h2").alias("edited_fingerprint"))
        .select("*", F.lead("fingerprint").over(Window.partitionBy("part").orderBy("row")).alias("next"))
    )
    opening = printed.where("row = 1").select(F.col("part").alias("next_part"), F.col("fingerprint").alias("other"))
    opening = scratch.save(after.withColumnRenamed("next", "next_part").join(opening, "next_part").select("part", "other"))
    out = printed.join(opening, "part")
    scratch.drop(words, firsts, ends, after)
    return out.select(
        F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next", "other")).alias("near_next"),
    )
