"""Queries over clusters: sizes, centres, witnesses, memberships and distances of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering
from .records import _DISTANCE, _SEEDS, _points, _seeds
from .registry import query

_NEAR = f"{_SEEDS}, ds AS (SELECT id, cluster, v, {_DISTANCE['l2']} AS d FROM pr)"


def _distances(s, d):
    return clustering.distances_to(_points(s, d).drop("cluster"), _seeds(s, d), "l2")


def _rounded(df, column="value"):
    return df.withColumn(column, F.round(column, 6) + F.lit(0.0))


@query("cluster_sizes", "SELECT label AS cluster, CAST(count(*) AS BIGINT) AS n, min(vec_id) AS first FROM embeddings GROUP BY label")
def _(s, d):
    return clustering.sizes(_points(s, d))


@query("cluster_witnesses", f"{_NEAR} SELECT * FROM (SELECT cluster, id, round(d, 6) AS d, CAST(row_number() OVER (PARTITION BY cluster ORDER BY d, id) AS BIGINT) AS rank FROM ds) WHERE rank <= 8")
def _(s, d):
    return clustering.witnesses(_distances(s, d), 8).withColumn("d", F.round("d", 6))


@query("centers_best", f"{_NEAR}, b AS (SELECT cluster, v FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, id) AS k FROM ds) WHERE k <= 8), e AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM b) SELECT cluster, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) + 0.0 AS value FROM e GROUP BY cluster, pos")
def _(s, d):
    return _rounded(clustering.best_centres(_points(s, d).drop("cluster"), _distances(s, d), 8))


_SOFT = f"{_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS rank FROM ds), q AS (SELECT id, cluster, v, power(rank, -1.5) AS x FROM r WHERE rank <= 4), m AS (SELECT id, cluster, v, x / sum(x) OVER (PARTITION BY id) AS p FROM q)"


@query("centers_weighted", f"{_SOFT}, e AS (SELECT cluster, p, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM m) SELECT cluster, CAST(pos - 1 AS INTEGER) AS pos, round(sum(p * x) / sum(p), 6) + 0.0 AS value FROM e GROUP BY cluster, pos")
def _(s, d):
    """Centres as sums weighted by soft memberships."""
    soft = clustering.membership(_distances(s, d), "inverse_rank", 4, 1.5)
    return _rounded(clustering.weighted_centres(_points(s, d).drop("cluster"), soft))


@query("centers_inverse", f"{_NEAR}, e AS (SELECT cluster, 1 / d AS p, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM ds WHERE d > 0) SELECT cluster, CAST(pos - 1 AS INTEGER) AS pos, round(sum(p * x) / sum(p), 6) + 0.0 AS value FROM e GROUP BY cluster, pos")
def _(s, d):
    """Centres as sums weighted by the inverse distances of all points but those at the old centres."""
    inverse = _distances(s, d).where("d > 0").select("id", "cluster", (1 / F.col("d")).alias("p"))
    return _rounded(clustering.weighted_centres(_points(s, d).drop("cluster"), inverse))


@query("cluster_joint", f"{_SOFT} SELECT cluster, id, round(p * (id % 7 + 1) / (SELECT sum(vec_id % 7 + 1) FROM embeddings), 9) AS p FROM m")
def _(s, d):
    """The joint distribution of clusters and elements, an element weighing id mod 7 + 1."""
    points = _points(s, d)
    weights = points.select("id", (F.col("id") % 7 + 1).alias("f"))
    return clustering.joint(clustering.membership(_distances(s, d), "inverse_rank", 4, 1.5), weights).withColumn("p", F.round("p", 9))


@query("cluster_map", f"{_NEAR} SELECT id, cluster FROM (SELECT id, cluster, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS k FROM ds) WHERE k = 1")
def _(s, d):
    return clustering.best_map(clustering.membership(_distances(s, d), "inverse_rank", 4, 1.5))


@query("d2p_own_rank", f"{_NEAR}, r AS (SELECT ds.id, ds.cluster, row_number() OVER (PARTITION BY ds.id ORDER BY CASE WHEN ds.cluster <> pts.cluster THEN 1 ELSE 0 END, d, ds.cluster) AS rank FROM ds JOIN pts ON ds.id = pts.id), q AS (SELECT id, cluster, power(rank, -1.5) AS x FROM r WHERE rank <= 4) SELECT id, cluster, round(x / sum(x) OVER (PARTITION BY id), 6) AS p FROM q")
def _(s, d):
    """Memberships by rank in which a vector's own label comes first."""
    return _rounded(clustering.membership(_distances(s, d), "inverse_rank", 4, 1.5, assigned=_points(s, d).select("id", "cluster")), "p")


_WEIGHTS = [1 / (k + 1) if k % 8 else 0.0 for k in range(64)]
_WEIGHTED = "list_sum(list_transform(range(1, 65), lambda k: CASE WHEN (k - 1) % 8 = 0 THEN 0 ELSE 1.0 / k END * {})) / (SELECT sum(CASE WHEN (k - 1) % 8 = 0 THEN 0 ELSE 1.0 / k END) FROM (SELECT unnest(range(1, 65)) AS k))"

for _name, _part in (("l1", "abs(v[k] - c[k])"), ("l2", "(v[k] - c[k]) * (v[k] - c[k])")):

    def _add_weighted(name: str, part: str) -> None:
        @query(f"dist_weighted_{name}", f"{_SEEDS} SELECT id, cluster, round({_WEIGHTED.format(part)}, 6) AS d FROM pr")
        def _(s, d):
            """Distances with a weight for each feature, every eighth masked."""
            measure = clustering.weighted(name, _WEIGHTS)
            return _points(s, d).drop("cluster").crossJoin(F.broadcast(_seeds(s, d))).select("id", "cluster", F.round(measure(F.col("v"), F.col("centre")), 6).alias("d"))

    _add_weighted(_name, _part)


@query("row_distances", f"WITH pr AS (SELECT least(q.vec_id, e.vec_id) AS a, greatest(q.vec_id, e.vec_id) AS b, CAST(q.embedding AS DOUBLE[]) AS v, CAST(e.embedding AS DOUBLE[]) AS c FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND (q.vec_id < e.vec_id OR (q.vec_id > e.vec_id AND e.vec_id % 50 <> 0))) SELECT a, b, round({_DISTANCE['l1']}, 6) AS d FROM pr")
def _(s, d):
    """Every fiftieth vector against all others, each pair once."""
    points = _points(s, d).drop("cluster")
    return clustering.row_distances(points.where("id % 50 = 0"), points, "l1").withColumn("d", F.round("d", 6))
