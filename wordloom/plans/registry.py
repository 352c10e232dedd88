"""The registry of queries and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SENTENCES = r"""
lines AS (SELECT doc_id, lang, source, unnest(l) AS line, generate_subscripts(l, 1) AS sid FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)),
sents AS (SELECT * FROM (SELECT doc_id, lang, source, sid, regexp_extract_all(lower(line), '[\p{L}\p{M}\p{N}]+') AS toks FROM lines) WHERE len(toks) > 0),
tok AS (SELECT doc_id, lang, source, sid, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM sents),
uni AS (SELECT w, CAST(count(*) AS BIGINT) AS f FROM tok GROUP BY w)
"""

PADDED = """,
pad AS (SELECT doc_id, sid, list_concat(['__$'], toks, ['__$']) AS p FROM sents),
ptok AS (SELECT doc_id, sid, unnest(p) AS w, generate_subscripts(p, 1) AS pos FROM pad),
big AS (SELECT w1, w2, CAST(count(*) AS BIGINT) AS f FROM (SELECT w AS w1, lead(w) OVER (PARTITION BY doc_id, sid ORDER BY pos) AS w2 FROM ptok) WHERE w2 IS NOT NULL GROUP BY w1, w2)
"""


def query(name: str, sql: str | None = None, base: str = "") -> Callable[[Query], Query]:
    """Register a query; ``sql`` is put after the common tables named by ``base`` (tok or big)."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = {"": "", "tok": f"WITH {SENTENCES}", "big": f"WITH {SENTENCES}{PADDED}"}[base] + sql
        return f

    return add
