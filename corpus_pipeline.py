"""From raw documents to packed sequences: five stages, each applied to all that its predecessor kept.

They apply operators 3, 5, 10, 9 and 8.  The third (``near_copies``) takes the
pairs of operator 10's covering masks over SimHash prints of five-word shingles,
and more by least hashes, as few pairs at a Jaccard index of 0.8 are within its
bits; links are those whose whole sets prove that index.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import exact_substrings, line_dedup, near_copies, packing, perplexity
from wordloom.llm.common import passing, stored, table
from wordloom.llm.token_cache import default_path

MATCH = 200
"""Bytes of a string that must repeat to be removed: a passage of 50 words seldom has less."""

_INTERNAL = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "distance", "low", "high", "middle", "q1", "q3", "_lang",
    "n_lines", "n_removed", "n_bytes", "n_spans", "kept_sha256", "_doc", "_text", "_lines", "lines", "_kept", "_n", "gone", "doc", "body", "spans", "_block", "_kind", "_h", "_logp", "_own", "before", "windows",
]
"""Names that the operators use beside the columns of their input."""


def _apart(docs: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``apply`` to the rows with clashing columns renamed, and their names back afterwards."""
    names = docs.columns
    moved: dict[str, str] = {}
    for c in names:
        if c in _INTERNAL:
            moved[c] = next(x for x in (f"own_{i}_{c}" for i in itertools.count()) if x not in names)
    out = apply(docs.withColumnsRenamed(moved))
    return out.select(*[F.col(moved.get(c, c)).alias(c) for c in names])


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their language's perplexity band go.

    Null texts fail; null languages are one language; repeated rows stay or go together.
    ``docs`` is read from files, as every stage's is.
    """
    return _apart(docs, lambda d: perplexity.judged(d, d.columns, from_files=True).where("kept"))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; so do documents of which nothing but white space is left, null texts too."""
    return _counted(_apart(docs, line_dedup.deduplicated).where(F.col("text").rlike(r"\S")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Links are pairs whose five-word shingles have a Jaccard index of 0.8 or more,
    found by operator 10's covering masks and, beyond its bits, by least hashes.
    Rows of one doc_id and text are one document; of different texts with one
    doc_id, that with the least hash comes first; rows without a doc_id come
    after all others.  Texts without words, null ones too, are one group.
    """
    mark = next(x for x in (f"_mark{i}" for i in itertools.count()) if x not in docs.columns)
    with passing(spark) as lasting:
        keep = lasting(near_copies.groups_of(docs.select("doc_id", "text")).where("kept").select(F.col("mark").alias(mark)).distinct(), "keep")
    met = docs.withColumn(mark, F.xxhash64("doc_id", "text")).join(keep, mark)
    return met.dropDuplicates([mark]).select(docs.columns)  # dealt by the mark already


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated strings of ``MATCH`` bytes go; so do documents of which nothing but white space is left.

    Rows without a doc_id count like others, repeated rows lose what they share
    with each other, and null texts go.
    """
    return _counted(_apart(docs, lambda d: exact_substrings.without_repeats(d, match=MATCH)).where(F.col("text").rlike(r"\S")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences.

    A null text is packed as an empty one, by its end mark alone; each repeated
    row is packed by itself; other columns than doc_id and text play no part.
    """
    return packing.packed_pieces(docs, default_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_windows),
    ("near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_substrings),
    ("packing", packed),
]

ORACLE_SQL = None
"""SQL has neither the perplexity model nor the tokenizer; the tests compare the three dedup stages with brute force, and the run with its stages chained."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split(" ")[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
