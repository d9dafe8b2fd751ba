"""Corpus pipeline: language identification, exact and near deduplication,
removal of repeated byte strings, packing into token sequences.

Each stage works on all rows that the one before kept, and each but the last
returns the columns of ``documents``.  Stages name rows by doc_id and text, so
that repeated doc_ids don't mix.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.llm import bwtdedup, exactdedup, langid, orderhash, packing
from marginalia.llm.common import Scratch, ascii_lower, read
from marginalia.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Language predictions below this share are rejected.
MIN_SCORE = 0.35


def identify_language(spark, docs, sf_dir):
    """Rows whose language can be told; ``lang`` becomes the prediction.

    Rows without a letter, with null text, or whose best language weighs less
    than ``MIN_SCORE`` go."""
    found = langid.identify(docs.select("doc_id", "text", "lang", "source", "n_chars"), ("text", "source", "n_chars"))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_exact_copies(spark, docs, sf_dir):
    """Of equal texts (A-Z folded) the row with the largest doc_id.

    Null text counts as empty.  Repeated rows of the doc_id that stays all
    stay; a null doc_id stays only where its text has no other.  No rows give
    none."""
    judged = exactdedup.dedup_table(docs)
    gone = judged.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct().hint("merge")  # it grows with the corpus
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    return docs.select(*COLUMNS).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (sha == F.col("_sha")), "left_anti")


def drop_near_copies(spark, docs, sf_dir):
    """Of each class of near-duplicates the row with the smallest doc_id.

    Null text counts as empty, and texts without words are one class.
    Repeated rows of the doc_id that stays all stay; a null doc_id counts as
    the smallest.  No rows give none."""
    judged = orderhash.classes(docs)
    gone = judged.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct().hint("merge")  # it grows with the corpus
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(*COLUMNS).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (hashed == F.col("_hash")), "left_anti")


def cut_repeats(spark, docs, sf_dir):
    """Texts without byte strings that start in an earlier document.

    Null text counts as empty; rows of one doc_id don't cut each other.  No
    rows give none.  Where a removed run ends inside a character, what is left of it goes too.
    Rows that keep no text go."""
    cut = bwtdedup.dedup(docs.select(*COLUMNS), ("lang", "source"))
    text = F.decode(F.col("kept"), "UTF-8")
    valid = F.when(F.is_valid_utf8(F.col("kept").cast("string")), text).otherwise(F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))
    left = cut.select("doc_id", valid.alias("text"), "lang", "source")
    return left.where("text <> ''").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack_sequences(spark, docs, sf_dir):
    """Pieces of token sequences of at most 2048 ids.  ``ids`` is base64 of
    little-endian 32-bit ids.

    A row without text is its closing id alone; repeated rows are each packed;
    no rows give none."""
    pieces, places = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), 2048, 0)
    return pieces.join(places, "uid").select("sequence_id", "offset", "doc_id", "piece", "start", "length", F.base64("ids").alias("ids"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("repeated_strings", cut_repeats),
    ("packing", pack_sequences),
]

#: Automata, sketches, transforms and a tokeniser are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each is written and read again."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
