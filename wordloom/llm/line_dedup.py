"""Line deduplication by overlapping three-line windows (operator 5), in DataFrame functions only.

Every run of three consecutive lines is hashed.  A window's first occurrence is
the one with the smallest doc_id and position; all lines that a later occurrence
covers are removed.  Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LINES = 3


def _lines(text: str):
    return F.split(F.col(text), "\n", -1)


def deduplicated(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, the text without repeated windows, and n_lines, n_removed.

    Windows of blank lines are left alone.  Rows that agree in doc_id and text
    count as one document, and each of them is kept alike; null doc_ids come
    first.  A null text has no lines and stays null; a text of fewer than three
    lines is never changed; a text all of whose lines go becomes empty.
    Columns of ``docs`` named n_lines or n_removed are replaced.
    """
    own = docs.drop("n_lines", "n_removed")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_doc"), F.xxhash64("text").alias("_text")]
    starts = F.sequence(F.lit(1), F.size("lines") - (LINES - 1))
    texts = F.transform(starts, lambda i: F.array_join(F.slice("lines", i, F.lit(LINES)), "\n"))
    windows = own.select(*key, _lines("text").alias("lines")).where(F.size("lines") >= LINES).select("_doc", "_text", F.posexplode(texts).alias("pos", "w"))
    windows = stored(windows.where(F.col("w").rlike(r"\S")).select(F.unhex(F.md5("w")).alias("h"), F.struct("_doc", "_text", "pos").alias("at")), "windows")
    first = stored(windows.groupBy("h").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").select("h", "first"), "first")
    later = windows.join(first, "h").where("at > first").select("at.*")
    removed = later.groupBy("_doc", "_text").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    # What is kept lies before the first window, between two, and after the last.
    joined = own.select("*", *key).join(removed.hint("shuffle_hash"), ["_doc", "_text"], "left").withColumn("_lines", _lines("text")).withColumn("n_lines", F.coalesce(F.when(F.col("text").isNotNull(), F.size("_lines")), F.lit(0)).cast("long"))
    count = F.size("gone")
    end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("gone", F.greatest(i, F.lit(1))) + LINES)
    begin = lambda i: F.when(i == count, F.size("_lines")).otherwise(F.element_at("gone", F.least(i + 1, count)))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), count), lambda i: F.slice("_lines", end(i) + 1, F.greatest(begin(i) - end(i), F.lit(0)))))
    out = joined.withColumn("_kept", F.when(F.col("gone").isNotNull(), kept))
    text = F.when(F.col("gone").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col("text"))
    n_removed = F.coalesce(F.col("n_lines") - F.size("_kept"), F.lit(0)).cast("long")
    return out.withColumn("_n", F.when(F.col("gone").isNotNull(), n_removed).otherwise(F.lit(0).cast("long"))).withColumn("text", text).select(*own.columns, "n_lines", F.col("_n").alias("n_removed"))


SQL = """
WITH l AS (
  SELECT doc_id, i AS pos, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), w AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS w
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM w WHERE w IS NOT NULL AND regexp_matches(w, '\\S')
  ) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM later, (SELECT unnest(range(0, 3)) AS d)
)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(gone.pos) AS BIGINT) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS kept_text
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id
"""


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text) for each row."""
    return deduplicated(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.col("text").alias("kept_text"))
