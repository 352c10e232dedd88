"""Ranked lexical search, reversed (operator 11).

The stated items are few beside the documents, so their terms are the index: an
inverted list of the items that hold each term is broadcast, and the documents
stream past it, once for the counts of documents that hold a term and once for
the scores.  A task keeps the ``KEEP`` best documents of every item, a bounded
heap each; Spark merges the heaps of all tasks.

The index is broadcast in blocks of about ``ITEMS`` items and ``POSTINGS``
postings, so its size is bounded whatever the number of items; every block meets
every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

KEEP = 10
"""Documents that are ranked for an item."""
ITEMS, POSTINGS = 1_000, 100_000
"""Items and pairs of item and term, about, of a block of the index."""
ROWS, BYTES = 2_000, 8_000_000
"""Documents, and about the bytes of their texts, that a task scores at once."""
SALTS = 64
"""Parts in which the heaps of many tasks are thinned before those of an item meet."""
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
"""A term: a maximal run of ASCII letters and digits and of all code points beyond ASCII."""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_bytes = np.arange(256)
_IN_TERM = (_bytes >= 0x80) | np.isin(_bytes, np.frombuffer((UPPER + LOWER + "0123456789").encode(), np.uint8))
_LOWERED = np.where((_bytes >= ord("A")) & (_bytes <= ord("Z")), _bytes + 32, _bytes).astype(np.uint8)


def terms_in(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, owner, term): how many terms each text has; of each place that holds a term of the vocabulary, its text and that term's place in the vocabulary."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if at[0] == at[-1]:
        return np.zeros(len(texts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = _LOWERED[np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]  # a text's end ends its last term
    begins = np.flatnonzero(begins)
    bounds = np.append(np.cumsum(inside)[begins] - 1, inside.sum()).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    owner = np.searchsorted(at, begins, "right") - 1
    term = pc.fill_null(pc.index_in(found, value_set=vocabulary), -1).to_numpy()
    held = term >= 0
    return np.bincount(owner, minlength=len(texts)), owner[held], term[held].astype(np.int64)


def weights(found: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each df."""
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * found + 1))).astype(np.int64)


def damped(n: np.ndarray, documents: int, places: int) -> np.ndarray:
    """100 - 90 + (90 n N) div L of each n; in Python's integers where 64 bits might not do."""
    if len(n) and 90 * int(n.max()) * documents >= 1 << 63:
        return np.array([10 + 90 * int(x) * documents // places for x in n], np.int64)
    return 10 + 90 * n.astype(np.int64) * documents // max(1, places)


class Heaps:
    """The ``size`` best (score, doc_id) of each of ``items``: highest scores first, equal ones by ascending doc_id."""

    def __init__(self, items: int, size: int):
        self.size = size
        self.least = np.ones(items, np.int64)  # what a score must reach to matter
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores`` has a row for each of ``docs`` and a column for each item."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, scores[row, item]), (self.doc, docs[row])))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.concatenate([[True], item[1:] != item[:-1]])
        rank = np.arange(len(item)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        full = rank == self.size - 1
        self.least[item[full]] = score[full]
        kept = rank < self.size
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, min(ROWS, BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _found(docs: DataFrame, vocabulary) -> tuple[np.ndarray, int, int]:
    """(df of each term of the broadcast vocabulary, N, L) over all of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.value
        found, documents, places = np.zeros(len(terms), np.int64), 0, 0
        for part in _slices(batches):
            n, owner, term = terms_in(part["text"], terms)
            found += np.bincount(np.unique(owner * len(terms) + term) % max(1, len(terms)), minlength=len(terms))
            documents, places = documents + int((n > 0).sum()), places + int(n.sum())
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(found[some], [documents, places]))], names=["term", "n"])

    sums = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r.term: r.n for r in sums.collect()}  # a row for each term of the block at most
    out = np.zeros(len(vocabulary.value), np.int64)
    for term, n in got.items():
        if term >= 0:
            out[term] = n
    return out, got.get(-1, 0), got.get(-2, 0)


def _block(docs: DataFrame, pairs: list[tuple[int, str]], keep: int) -> DataFrame | None:
    """(item_id, doc_id, score): the heaps of all tasks for the items of one block of (item, term)."""
    sc = docs.sparkSession.sparkContext
    terms, term_of = np.unique(np.array([t.encode() for _, t in pairs], object), return_inverse=True)
    items, item_of = np.unique(np.array([i for i, _ in pairs], np.int64), return_inverse=True)
    vocabulary = sc.broadcast(pa.array(terms.tolist(), pa.large_binary()))
    found, documents, places = _found(docs, vocabulary)
    if not places:
        return None
    order = np.argsort(term_of, kind="stable")
    index = sc.broadcast((items, item_of[order], np.searchsorted(term_of[order], np.arange(len(terms) + 1)), weights(found, documents)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, holders, begin, weight = index.value
        vocab = vocabulary.value
        heaps = Heaps(len(items), keep)
        for part in _slices(batches):
            n, owner, term = terms_in(part["text"], vocab)
            pair, tf = np.unique(term * part.num_rows + owner, return_counts=True)  # by term
            term, owner = np.divmod(pair, max(1, part.num_rows))
            share = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * damped(n, documents, places)[owner]))
            scores = np.zeros((part.num_rows, len(items)), np.int64)
            ends = np.append(np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else [], len(term)).astype(np.int64)
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                those = holders[begin[term[lo]] : begin[term[lo] + 1]]
                scores[owner[lo:hi, None], those[None, :]] += share[lo:hi, None]
            heaps.add(scores, part["doc_id"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(items[heaps.item]), pa.array(heaps.doc), pa.array(heaps.score)], names=["item_id", "doc_id", "score"])

    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(search, "item_id long, doc_id long, score long")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the different terms of each item."""
    lowered = F.translate("text", UPPER, LOWER)
    return items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))).alias("term")).distinct()


def best(rows: DataFrame, group: str, order: list, keep: int, name: str = "rank") -> DataFrame:
    """The first ``keep`` rows of each group, with their rank; a group's rows are thinned in ``SALTS`` parts before they meet."""
    salt = Window.partitionBy(group, "salt_").orderBy(*order)
    whole = Window.partitionBy(group).orderBy(*order)
    thin = rows.withColumn("salt_", F.pmod(F.spark_partition_id(), F.lit(SALTS))).withColumn(name, F.row_number().over(salt)).where(F.col(name) <= keep)
    return thin.drop("salt_").withColumn(name, F.row_number().over(whole)).where(F.col(name) <= keep)


def ranked(docs: DataFrame, items: DataFrame, keep: int = KEEP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``keep`` best documents of each item with a score above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text; both ids are
    integers.  Null and empty texts have no terms, and do not count as
    documents.  Rows of one item_id are one item, with the terms of all; rows
    without an item_id are left out.  Every row of ``docs`` is a document, also
    where rows repeat or share a doc_id; those without a doc_id count in the
    statistics but are not ranked.  Ties go to the smaller doc_id.  Without items
    or documents there are no rows; extra columns are ignored.
    """
    pairs = stored(item_terms(items), "postings")
    size = pairs.agg(F.count("*"), F.count_distinct("item_id")).first()
    blocks = max(-(-size[0] // POSTINGS), -(-size[1] // ITEMS))
    out = None
    for block in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about POSTINGS at most
        heaps = _block(docs, [(r.item_id, r.term) for r in rows], keep) if rows else None
        if heaps is not None:
            heaps = stored(heaps, "heaps")
            out = heaps if out is None else out.unionByName(heaps)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    return best(out, "item_id", [F.desc("score"), "doc_id"], keep).select("item_id", "rank", "doc_id", "score")


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"

SQL = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS places FROM d),
f AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s GROUP BY term, all_docs),
m AS (SELECT doc_id, 10 + (90 * n * all_docs) // places AS m FROM d, s),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM f JOIN w USING (term) JOIN m USING (doc_id) JOIN q USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
WHERE rank <= {KEEP}
"""
