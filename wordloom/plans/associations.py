"""A query for each association measure, over the 500 most frequent targets and 200 most frequent bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import kept
from ..operators import profiles
from .registry import query
from .text import _TOPS, counted, unigrams

_PAIRS = _TOPS + """,
ex AS (SELECT 'left' AS dir, w2 AS t, w1 AS b, f FROM big WHERE w2 IN (SELECT w FROM targets) AND w1 IN (SELECT w FROM bounds)
 UNION ALL SELECT 'right', w1, w2, f FROM big WHERE w1 IN (SELECT w FROM targets) AND w2 IN (SELECT w FROM bounds)),
g AS (SELECT dir, t.w AS t, b.w AS b FROM (SELECT unnest(['left', 'right']) AS dir), targets t, bounds b),
dense AS (SELECT g.dir, g.t, g.b, coalesce(ex.f, 0) AS f FROM g LEFT JOIN ex USING (dir, t, b)),
m2 AS (SELECT w2 AS w, sum(f) AS f, count(*) AS k FROM big GROUP BY w2), m1 AS (SELECT w1 AS w, count(*) AS k FROM big GROUP BY w1),
pr AS (SELECT x.dir, x.t, x.b, CAST(x.f AS DOUBLE) AS f, CAST(sum(x.f) OVER (PARTITION BY x.dir, x.t) AS DOUBLE) AS ftl, CAST(sum(x.f) OVER (PARTITION BY x.dir, x.b) AS DOUBLE) AS fbl, CAST(sum(x.f) OVER (PARTITION BY x.dir) AS DOUBLE) AS nl,
 CAST(t2.f AS DOUBLE) AS ft, CAST(b2.f AS DOUBLE) AS fb, (SELECT CAST(sum(f) AS DOUBLE) FROM big) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM big) AS nz,
 CAST(CASE WHEN x.dir = 'left' THEN t2.k ELSE t1.k END AS DOUBLE) AS nzt, CAST(CASE WHEN x.dir = 'left' THEN b1.k ELSE b2.k END AS DOUBLE) AS nzb, (SELECT CAST(count(*) AS DOUBLE) FROM targets) AS nt, (SELECT CAST(count(*) AS DOUBLE) FROM bounds) AS nb
 FROM {} x JOIN m2 t2 ON x.t = t2.w JOIN m2 b2 ON x.b = b2.w JOIN m1 t1 ON x.t = t1.w JOIN m1 b1 ON x.b = b1.w)"""


def _profile(s, d, dense: bool):
    uni, big = counted(s, d)
    return profiles.profile(big, kept(profiles.most_frequent(uni, 500), "targets"), kept(profiles.most_frequent(uni, 200), "bounds"), dense)


def _add(name: str, expression: str, dense: bool) -> None:
    sql = _PAIRS.format("dense" if dense else "ex") + f" SELECT dir, t, b, round(CAST({expression} AS DOUBLE), 5) + 0.0 AS value FROM pr"

    @query(f"lr_{name}", sql, "big")
    def _(s, d):
        return profiles.measured(_profile(s, d, dense), name).withColumn("value", F.round("value", 5) + F.lit(0.0))


for _name, _expression in profiles.SPARSE.items():
    _add(_name, _expression, False)
for _name, _expression in profiles.DENSE.items():
    _add(_name, _expression, True)

_VALUES = _PAIRS.format("ex") + ", v AS (SELECT dir, t, b, log2(f * nl / (ftl * fbl)) AS value FROM pr)"
_HOW = {
    "mass": "value / nullif(sum(value) OVER (PARTITION BY dir, t), 0)",
    "column_mass": "value / nullif(sum(value) OVER (PARTITION BY dir, b), 0)",
    "absolute": "value / nullif(sum(abs(value)) OVER (PARTITION BY dir, t), 0)",
    "limit": "value / nullif(max(abs(value)) OVER (PARTITION BY dir, t), 0)",
    "stretch": "CASE WHEN value > 0 THEN value / max(greatest(value, 0)) OVER (PARTITION BY dir, t) WHEN value < 0 THEN value / max(greatest(-value, 0)) OVER (PARTITION BY dir, t) ELSE 0 END",
}


def _add_norm(how: str, expression: str) -> None:
    # Whole numbers, whose sums are the same in any order, need no rounding.
    name = "raw" if how in ("mass", "column_mass") else "mi"
    values = _VALUES if name == "mi" else _VALUES.replace("log2(f * nl / (ftl * fbl)) AS value", "f AS value")
    shown = f"coalesce({expression}, 0)" if name == "raw" else f"round(coalesce({expression}, 0), 5) + 0.0"

    @query(f"lr_norm_{how}", values + f" SELECT dir, t, b, {shown} AS value FROM v", "big")
    def _(s, d):
        out = profiles.normalized_rows(profiles.measured(_profile(s, d, False), name), how)
        return out if name == "raw" else out.withColumn("value", F.round("value", 5) + F.lit(0.0))


for _how, _expression in _HOW.items():
    _add_norm(_how, _expression)


@query("lr_strongest", _VALUES.replace("log2(f * nl / (ftl * fbl)) AS value", "round(log2(f * nl / (ftl * fbl)), 5) + 0.0 AS value") + " SELECT * FROM (SELECT dir, t, b, value, CAST(row_number() OVER (PARTITION BY dir, t ORDER BY value DESC, b) AS BIGINT) AS rank FROM v) WHERE rank <= 5", "big")
def strongest(s, d):
    """The five bounds of the largest mutual information with each target, in each direction."""
    values = profiles.measured(_profile(s, d, False), "mi").withColumn("value", F.round("value", 5) + F.lit(0.0))
    return profiles.strongest(values, 5)


@query("lr_remap_bounds", _PAIRS.format("ex") + " SELECT dir, t, substr(b, 1, 1) AS b, CAST(sum(f) AS DOUBLE) AS f FROM ex GROUP BY dir, t, substr(b, 1, 1)", "big")
def _(s, d):
    """Bounds replaced by hard classes: their first letters."""
    uni, big = counted(s, d)
    targets, bounds = kept(profiles.most_frequent(uni, 500), "targets"), kept(profiles.most_frequent(uni, 200), "bounds")
    classes = bounds.select(F.col("w").alias("b"), F.substring("w", 1, 1).alias("c"), F.lit(1.0).alias("p"))
    return profiles.remapped_bounds(profiles.extracted(big, targets, bounds), classes)


@query("lr_invert", _TOPS + ", j AS (SELECT substr(w, 1, 1) AS c, w AS b, uni.f FROM bounds JOIN uni USING (w)) SELECT c, b, round(f / sum(f) OVER (PARTITION BY c), 9) AS p FROM j", "tok")
def _(s, d):
    uni = kept(unigrams(s, d), "unigrams")
    bounds = kept(profiles.most_frequent(uni, 200), "bounds")
    classes = bounds.select(F.col("w").alias("b"), F.substring("w", 1, 1).alias("c"), F.lit(1.0).alias("p"))
    return profiles.inverted(classes, uni.select(F.col("w").alias("b"), "f")).withColumn("p", F.round("p", 9))
