"""Queries over records, groups, vectors and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.storage import kept, table
from ..operators import clustering, collection, fitting
from ..streaming import counts
from .registry import query

_AGGREGATES = {
    "min": "min(x)", "max": "max(x)", "sum": "coalesce(sum(x), 0)", "prod": "coalesce(product(x), 1)", "count": "count(*)", "nvalues": "count(DISTINCT x)", "ndefined": "count(x)",
    "nnz": "count(*) FILTER (WHERE x <> 0)", "avg": "coalesce(avg(x), 0)", "var": "coalesce(var_pop(x), 0)", "stddev": "coalesce(stddev_pop(x), 0)", "med": "coalesce(median(x), 0)",
    "mvar": "abs(avg(x * x) - median(x) * median(x))", "mdev": "sqrt(abs(avg(x * x) - median(x) * median(x)))",
}
_COUNTS = {"count", "nvalues", "ndefined", "nnz"}


def _add_aggregate(name: str, sql: str) -> None:
    x = "1 + l_discount / 1000" if name == "prod" else "l_quantity"
    digits = {"prod": 2}.get(name, 4)
    cast = f"CAST({sql} AS BIGINT)" if name in _COUNTS else f"round(CAST({sql} AS DOUBLE), {digits})"

    @query(f"agg_{name}", f"SELECT l_returnflag, l_linestatus, {cast} AS {name} FROM (SELECT l_returnflag, l_linestatus, {x} AS x FROM lineitem) GROUP BY l_returnflag, l_linestatus")
    def _(s, d):
        rows = table(s, d, "lineitem").withColumn("x", F.expr(x))
        out = collection.aggregated(rows, ["l_returnflag", "l_linestatus"], "x", [name])
        return out if name in _COUNTS else out.withColumn(name, F.round(F.col(name).cast("double"), digits))


for _name, _sql in _AGGREGATES.items():
    _add_aggregate(_name, _sql)

for _name, _middle in (("avgdev", "avg"), ("amdev", "median")):

    def _add_deviation(name: str, middle: str) -> None:
        @query(f"agg_{name}", f"SELECT l_returnflag, l_linestatus, round(avg(abs(l_quantity - m)), 4) AS {name} FROM lineitem JOIN (SELECT l_returnflag, l_linestatus, {middle}(l_quantity) AS m FROM lineitem GROUP BY ALL) USING (l_returnflag, l_linestatus) GROUP BY l_returnflag, l_linestatus")
        def _(s, d):
            return collection.aggregated(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", [name]).withColumn(name, F.round(name, 4))

    _add_deviation(_name, _middle)


def _records(s, d):
    """Orders as records of three variables."""
    return table(s, d, "orders").select("o_orderkey", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority", F.lit("cust"), F.col("o_custkey").cast("string")).alias("uvars"))


_KEY = "'cust=>' || o_custkey || ' && priority=>' || o_orderpriority || ' && status=>' || o_orderstatus"


@query("coll_key", f"SELECT o_orderkey, {_KEY} AS key FROM orders")
def _(s, d):
    return collection.keyed(_records(s, d)).select("o_orderkey", "key")


@query("coll_select", f"SELECT o_orderkey, {_KEY} AS key FROM orders WHERE o_orderstatus = 'F' AND o_custkey > 100")
def _(s, d):
    return collection.keyed(collection.selected(_records(s, d), "uvars['status'] = 'F' AND CAST(uvars['cust'] AS INT) > 100")).select("o_orderkey", "key")


@query("coll_project", "SELECT o_totalprice, o_orderkey FROM orders")
def _(s, d):
    return collection.projected(table(s, d, "orders"), ["o_totalprice", "no_such_column", "o_orderkey"])


@query("coll_groupby", f"SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n, min({_KEY}) AS first FROM orders GROUP BY 1, 2")
def _(s, d):
    return collection.grouped(_records(s, d), ["status", "priority"])


@query("coll_groupover", "SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def _(s, d):
    return collection.grouped_over(_records(s, d), ["cust"], ["status", "priority", "cust"]).drop("first")


@query("coll_ungroup", f"SELECT {_KEY} AS key FROM orders")
def _(s, d):
    return collection.keyed(collection.ungrouped(collection.members(_records(s, d), ["status"]), ["status"])).select("key")


@query("coll_common", "SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN max(o_orderstatus) END AS status, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(collection.common_value(F.col("o_orderstatus")).alias("status"), F.count("*").alias("n"))


@query("coll_union_clobber", "SELECT o_orderkey, o_totalprice * 2 AS price FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def _(s, d):
    orders = table(s, d, "orders")
    return collection.clobbered(orders.select("o_orderkey", F.col("o_totalprice").alias("price")), orders.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("price")), "o_orderkey")


@query("coll_remove", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(s, d):
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return collection.removed(table(s, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@query("coll_listing", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def _(s, d):
    return collection.first_of_each(table(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("path_value", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("mixed_order", "SELECT CAST(row_number() OVER (ORDER BY CAST(json_extract_string(props, '$.k') AS DOUBLE) NULLS FIRST, event_id) AS BIGINT) AS place, event_id FROM events")
def _(s, d):
    from ..operators.dictionary import indexed

    rows = table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return indexed(rows, [*collection.mixed_order(F.col("k")), "event_id"], "place", 1).select("place", "event_id")


@query("stats_bundle", "SELECT event_type, round(avg(value), 6) AS mean, round(sqrt(avg(value * value)), 6) AS rms, round(median(value), 6) AS median, min(value) AS least, max(value) AS most, round(covar_pop(value, user_id), 3) AS covariance FROM events GROUP BY event_type")
def _(s, d):
    v, events = F.col("value"), table(s, d, "events")
    sums = events.groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.sqrt(F.avg(v * v)), 6).alias("rms"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.covar_pop("value", "user_id"), 3).alias("covariance"))
    return sums.join(collection.medians(events, ["event_type"], "value").withColumn("median", F.round("median", 6)), "event_type")


@query("z_scores", "SELECT event_id, round((value - m) / s, 6) AS z FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY event_type) USING (event_type)")
def _(s, d):
    events = table(s, d, "events")
    moments = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return events.join(moments, "event_type").select("event_id", F.round(fitting.standardized(F.col("value"), F.col("m"), F.col("s")), 6).alias("z"))


@query("gaussian_fit", "SELECT round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS deviation, round(1 / (stddev_pop(l_quantity) * sqrt(2 * pi())), 6) AS peak FROM lineitem")
def _(s, d):
    out = fitting.gaussian_fit(table(s, d, "lineitem"), "l_quantity")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("window_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    return counts.event_windows(table(s, d, "events")).withColumn("total", F.round("total", 4))


# Vectors: the first vector of each label stands for a cluster.


def _points(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("v"))


def _seeds(s, d):
    """(cluster, centre): one vector a label, of which there are a few."""
    return kept(_points(s, d).groupBy("cluster").agg(F.min_by("v", "id").alias("centre")), "seeds")


_SEEDS = "WITH seeds AS (SELECT label AS cluster, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS c FROM embeddings GROUP BY label), pts AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), pr AS (SELECT id, seeds.cluster, v, c FROM pts, seeds)"
_CENTRED = "list_transform({0}, lambda x: x - list_avg({0}))"
_R = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1}))".format(_CENTRED.format("v"), _CENTRED.format("c"))
_BC = "list_sum(list_transform(list_zip(v, c), lambda z: sqrt(abs(z[1]) / list_sum(list_transform(v, lambda q: abs(q))) * abs(z[2]) / list_sum(list_transform(c, lambda q: abs(q))))))"
_KL = "(SELECT sum({0} * ln(({0}) / ({1}))) FROM (SELECT unnest(list_zip(list_transform(v, lambda q: abs(q)), list_transform(c, lambda q: abs(q)))) AS z, list_sum(list_transform(v, lambda q: abs(q))) AS sv, list_sum(list_transform(c, lambda q: abs(q))) AS sc) WHERE z[1] > 0 AND z[2] > 0)"
_DISTANCE = {
    "l1": "list_sum(list_transform(list_zip(v, c), lambda z: abs(z[1] - z[2]))) / len(v)",
    "l2": "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(v)",
    "cosine": "1 - list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c))",
    "absolute_cosine": "1 - abs(list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)))",
    "pearson": f"1 - {_R}",
    "absolute_pearson": f"1 - abs({_R})",
    "bhattacharyya": f"1 - {_BC}",
    "hellinger": f"0.5 * sqrt(greatest(2 - 2 * {_BC}, 0))",
    "divergence": _KL.format("z[1] / sv", "z[2] / sc"),
    "symmetric_divergence": "({} + {}) / 2".format(_KL.format("z[1] / sv", "z[2] / sc"), _KL.format("z[2] / sc", "z[1] / sv")),
}
_POSITIVE = {"bhattacharyya", "hellinger", "divergence", "symmetric_divergence"}
"""Distances of distributions, which want no values below 0: they get absolute ones."""


def _add_distance(name: str, sql: str) -> None:
    @query(f"dist_{name}", f"{_SEEDS} SELECT id, cluster, round({sql}, 6) + 0.0 AS d FROM pr")
    def _(s, d):
        points, seeds = _points(s, d).drop("cluster"), _seeds(s, d)
        if name in _POSITIVE:
            points, seeds = points.withColumn("v", F.transform("v", F.abs)), seeds.withColumn("centre", F.transform("centre", F.abs))
        return clustering.distances_to(points, seeds, name).withColumn("d", F.round("d", 6) + F.lit(0.0))


for _name, _sql in _DISTANCE.items():
    _add_distance(_name, _sql)

_RANKS = "list_transform({0}, lambda x: len(list_filter({0}, lambda y: y < x)) + (len(list_filter({0}, lambda y: y = x)) - 1) / 2.0)"


@query("dist_spearman", f"{_SEEDS.replace('pr AS (SELECT id, seeds.cluster, v, c FROM pts, seeds)', 'pr AS (SELECT id, s.cluster, p.v, s.c FROM (SELECT id, ' + _RANKS.format('v') + ' AS v FROM pts) p, (SELECT cluster, ' + _RANKS.format('c') + ' AS c FROM seeds) s)')} SELECT id, cluster, round(1 - {_R}, 6) + 0.0 AS d FROM pr")
def _(s, d):
    points = _points(s, d).select("id", clustering.ranked(F.col("v")).alias("v"))
    seeds = _seeds(s, d).select("cluster", clustering.ranked(F.col("centre")).alias("centre"))
    return clustering.distances_to(points, seeds, "pearson").withColumn("d", F.round("d", 6) + F.lit(0.0))


@query("topm_nearest", f"{_SEEDS}, ds AS (SELECT id, cluster, {_DISTANCE['l2']} AS d FROM pr) SELECT * FROM (SELECT id, cluster, round(d, 6) AS d, CAST(row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS BIGINT) AS rank FROM ds) WHERE rank <= 3")
def _(s, d):
    return clustering.nearest(clustering.distances_to(_points(s, d).drop("cluster"), _seeds(s, d), "l2"), 3).withColumn("d", F.round("d", 6)).select("id", "cluster", "d", "rank")


@query("centers_mean", "SELECT label AS cluster, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) + 0.0 AS value FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos")
def _(s, d):
    return clustering.centres(_points(s, d)).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("centers_median", "SELECT label AS cluster, CAST(pos - 1 AS INTEGER) AS pos, round(median(x), 6) + 0.0 AS value FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos")
def _(s, d):
    return clustering.centres(_points(s, d), "median").withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("kmeans_step", f"{_SEEDS}, ds AS (SELECT id, cluster, v, row_number() OVER (PARTITION BY id ORDER BY {_DISTANCE['l2']}, cluster) AS k FROM pr), a AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM ds WHERE k = 1) SELECT cluster, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) + 0.0 AS value FROM a GROUP BY cluster, pos")
def _(s, d):
    points = _points(s, d).drop("cluster")
    now = clustering.attached(points, _seeds(s, d), "l2")
    return clustering.centres(points.join(now, "id")).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("kmeans")
def _(s, d):
    """Assignments of k-means from the labels' first vectors, run to the end."""
    return clustering.kmeans(_points(s, d).drop("cluster"), _seeds(s, d))


@query("buckshot")
def _(s, d):
    """All vectors attached to the clusters of agglomerated prototypes, the square root of k n of them."""
    return clustering.buckshot(_points(s, d).drop("cluster"), 10)


def _nations(s, d):
    """(id, v): for each nation the shares of its customers' segments."""
    counts = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("id"), "c_mktsegment").agg(F.count("*").alias("n"))
    segments = F.broadcast(counts.select("c_mktsegment").distinct())
    grid = counts.select("id").distinct().crossJoin(segments).join(counts, ["id", "c_mktsegment"], "left")  # nations by segments
    rows = grid.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c_mktsegment", F.coalesce("n", F.lit(0)).alias("n")))).alias("x"), F.sum("n").alias("whole"))
    return kept(rows.select("id", F.transform("x", lambda x: x["n"] / F.col("whole")).alias("v")), "nations")


@query("agglomerated")
def _(s, d):
    """The tree of all nations by their customers' segments: which goes into which, and at what distance."""
    return clustering.merges(_nations(s, d)).withColumn("height", F.round("height", 9))


@query("agglomerated_cut")
def _(s, d):
    """The same cut into five clusters."""
    points = _nations(s, d)
    return clustering.cut(points, kept(clustering.merges(points), "tree"), 5)


for _how in ("min", "max", "avg"):

    def _add_link(how: str) -> None:
        @query(f"link_{how}", f"WITH pr AS (SELECT q.vec_id AS id, e.label AS cluster, CAST(q.embedding AS DOUBLE[]) AS v, CAST(e.embedding AS DOUBLE[]) AS c FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) SELECT id, cluster, round({how}({_DISTANCE['l1']}), 6) AS d FROM pr GROUP BY id, cluster")
        def _(s, d):
            """Every fiftieth vector against all members of every label."""
            points = _points(s, d)
            return clustering.member_links(points.where("id % 50 = 0"), points, "l1", how).select("id", "cluster", F.round("d", 6).alias("d"))

    _add_link(_how)

for _how, _sql in clustering.MEMBERSHIP.items():

    def _add_membership(how: str, sql: str) -> None:
        @query(f"d2p_{how}", f"{_SEEDS}, ds AS (SELECT id, cluster, {_DISTANCE['l2']} AS d FROM pr), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS rank, min(d) OVER () AS dmin, max(d) OVER () AS dmax, min(CASE WHEN d > 0 THEN d END) OVER () AS dpos, 1.5 AS beta FROM ds), q AS (SELECT id, cluster, CAST({sql} AS DOUBLE) AS x FROM r WHERE rank <= 4) SELECT id, cluster, round(x / nullif(sum(x) OVER (PARTITION BY id), 0), 6) AS p FROM q")
        def _(s, d):
            return clustering.membership(clustering.distances_to(_points(s, d).drop("cluster"), _seeds(s, d), "l2"), how, 4, 1.5).withColumn("p", F.round("p", 6))

    _add_membership(_how, _sql)


@query("minkowski", f"{_SEEDS} SELECT id, cluster, round(power(list_sum(list_transform(list_zip(v, c), lambda z: power(abs(z[1] - z[2]), 3))), 1 / 3.0), 6) AS d FROM pr")
def _(s, d):
    return _points(s, d).drop("cluster").crossJoin(F.broadcast(_seeds(s, d))).select("id", "cluster", F.round(scalar.minkowski(F.col("v"), F.col("centre"), 3.0), 6).alias("d"))
