"""Distances, links, centres, k-means, agglomeration and soft membership."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dot, total
from ..functions.storage import kept


def _aggregate(a: Column, b: Column, each) -> Column:
    return F.aggregate(F.zip_with(a, b, each), F.lit(0.0), lambda s, x: s + x)


def _centred(a: Column) -> Column:
    mean = total(a) / F.size(a)
    return F.transform(a, lambda x: x.cast("double") - mean)


def _correlation(a: Column, b: Column) -> Column:
    x, y = _centred(a), _centred(b)
    spread = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(spread > 0, dot(x, y) / spread)


def _shares(a: Column) -> Column:
    whole = total(a)
    return F.transform(a, lambda x: x.cast("double") / whole)


DISTANCES = {
    "l1": lambda a, b: _aggregate(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))) / F.size(a),
    "l2": lambda a, b: _aggregate(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))) / F.size(a),
    "cosine": lambda a, b: 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)),
    "absolute_cosine": lambda a, b: 1 - F.abs(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))),
    "pearson": lambda a, b: F.coalesce(1 - _correlation(a, b), F.lit(1.0)),
    "absolute_pearson": lambda a, b: F.coalesce(1 - F.abs(_correlation(a, b)), F.lit(1.0)),
    "bhattacharyya": lambda a, b: 1 - _aggregate(_shares(a), _shares(b), lambda x, y: F.sqrt(x * y)),
    "hellinger": lambda a, b: 0.5 * F.sqrt(F.greatest(2 - 2 * _aggregate(_shares(a), _shares(b), lambda x, y: F.sqrt(x * y)), F.lit(0.0))),
    "symmetric_divergence": lambda a, b: (DISTANCES["divergence"](a, b) + DISTANCES["divergence"](b, a)) / 2,
    "divergence": lambda a, b: _aggregate(_shares(a), _shares(b), lambda x, y: F.when((x > 0) & (y > 0), x * F.log(x / y)).otherwise(0.0)),
}
"""Distances of two arrays of numbers; the last four expect values of at least 0."""


def ranked(a: Column) -> Column:
    """The mean ranks of an array's values, for Spearman's distance (Pearson's of ranks)."""
    return F.transform(a, lambda x: F.size(F.filter(a, lambda y: y < x)) + (F.size(F.filter(a, lambda y: y == x)) - 1) / 2.0)


def centres(points: DataFrame, how: str = "mean") -> DataFrame:
    """(cluster, pos, value): the mean or median of each component over the points (cluster, v)."""
    from .collection import medians

    each = points.select("cluster", F.posexplode("v").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    if how == "mean":
        return each.groupBy("cluster", "pos").agg(F.avg("x").alias("value"))
    return medians(each, ["cluster", "pos"], "x").withColumnRenamed("median", "value")


def as_vectors(values: DataFrame) -> DataFrame:
    """(cluster, centre) from (cluster, pos, value)."""
    return values.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("centre"))


def distances_to(points: DataFrame, vectors: DataFrame, distance: str) -> DataFrame:
    """(id, cluster, d): from each point to each centre; there are as many centres as clusters, a number the caller sets."""
    return points.select("id", "v").crossJoin(F.broadcast(vectors)).select("id", "cluster", DISTANCES[distance](F.col("v"), F.col("centre")).alias("d"))


def nearest(distances: DataFrame, m: int = 1) -> DataFrame:
    """The m nearest clusters of each point, ties to the smaller cluster."""
    order = Window.partitionBy("id").orderBy("d", "cluster")
    return distances.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= m)


def attached(points: DataFrame, vectors: DataFrame, distance: str) -> DataFrame:
    """(id, cluster): each point with its nearest centre, by one partial aggregate."""
    return distances_to(points, vectors, distance).groupBy("id").agg(F.min(F.struct("d", "cluster")).alias("m")).select("id", F.col("m.cluster").alias("cluster"))


def kmeans(points: DataFrame, start: DataFrame, distance: str = "l2", most: int = 20) -> DataFrame:
    """(id, cluster): assign and recentre from ``start`` (cluster, centre) until nothing changes."""
    vectors, seen = start, None
    while True:
        now = kept(attached(points, vectors, distance), "assigned")
        digest = now.agg(F.sum(F.xxhash64("id", "cluster").cast("decimal(38,0)"))).first()[0]
        most -= 1
        if digest == seen or most <= 0:
            return now
        seen = digest
        vectors = kept(as_vectors(centres(points.join(now, "id"))), "centres")


def links(left: DataFrame, right: DataFrame, distance: str, how: str) -> DataFrame:
    """(cluster, id, d): the ``min``, ``max`` or ``avg`` distance of each row (id, v) to the members of each cluster (cluster, v).

    One side must be a bounded set of prototypes: every pair is compared.
    """
    pairs = right.select("id", F.col("v").alias("a")).crossJoin(F.broadcast(left.select("cluster", F.col("v").alias("b"))))
    fold = {"min": F.min, "max": F.max, "avg": F.avg}[how]
    return pairs.withColumn("d", DISTANCES[distance](F.col("a"), F.col("b"))).groupBy("cluster", "id").agg(fold("d").alias("d"))


LINKS = {
    "average": "sum(d * m * n) / sum(m * n)",
    "minimum": "min(d)",
    "maximum": "max(d)",
}
"""How the distance of two merged clusters comes from those of their parts, of m and n elements."""


def merges(points: DataFrame, distance: str = "l1", link: str = "average") -> DataFrame:
    """(a, b, height, size): the tree of agglomerative clustering; cluster b, named by its least element, goes into a.

    In a round all clusters that are each other's nearest merge at once, which for these links gives
    the tree that merging the nearest two at a time gives (ties to the lowest
    pair, distances to twelve places).  It needs a row for each two points: they
    are for a caller who bounds them, as ``buckshot`` does.
    """
    close = F.round(DISTANCES[distance](F.col("q_v"), F.col("v")), 12).alias("d")
    pairs = kept(paired(points.select("id", "v"), points.select("id", "v")).where(F.col("q_id") < F.col("id")).select(F.col("q_id").alias("i"), F.col("id").alias("j"), close), "pairs")
    sizes = kept(points.select("id", F.lit(1).cast("long").alias("n")), "sizes")
    out: list[DataFrame] = []
    while True:
        either = pairs.select(F.col("i").alias("id"), F.struct("d", F.col("j").alias("to")).alias("m")).unionByName(pairs.select(F.col("j").alias("id"), F.struct("d", F.col("i").alias("to")).alias("m")))
        near = kept(either.groupBy("id").agg(F.min("m").alias("m")).select("id", "m.to", "m.d"), "nearest")
        joined = near.select(F.col("id").alias("a"), F.col("to").alias("b"), F.col("d").alias("height")).join(near.select(F.col("id").alias("b"), F.col("to").alias("a")), ["a", "b"]).where("a < b")
        with_size = joined.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
        now = kept(with_size.select("a", "b", "height", (F.col("na") + F.col("nb")).alias("size")), "merges")
        if now.isEmpty():
            break
        out.append(now)
        gone = now.select(F.col("b").alias("id"), F.col("a").alias("into"))
        moved = sizes.join(gone, "id", "left").select("id", "n", F.coalesce("into", "id").alias("into"))
        left, right = moved.select(F.col("id").alias("i"), F.col("n").alias("m"), F.col("into").alias("x")), moved.select(F.col("id").alias("j"), "n", F.col("into").alias("y"))
        met = pairs.join(left, "i").join(right, "j").where("x <> y").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "d", "m", "n")
        pairs = kept(met.groupBy("i", "j").agg(F.round(F.expr(LINKS[link]), 12).alias("d")), "pairs")
        sizes = kept(moved.groupBy(F.col("into").alias("id")).agg(F.sum("n").alias("n")), "sizes")
    if not out:
        return points.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("height"), F.lit(0).cast("long").alias("size"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def cut(points: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """(id, cluster): the k clusters that are left without the k - 1 highest merges, numbered by their least elements."""
    high = tree.orderBy(F.desc("height"), F.desc("size"), F.desc("a"), F.desc("b")).limit(k - 1)
    below = tree.select("a", "b").join(high.select("a", "b"), ["a", "b"], "left_anti")
    hops = kept(points.select("id").join(below.select(F.col("b").alias("id"), "a"), "id", "left").select("id", F.coalesce("a", "id").alias("to")), "hops")
    while True:
        on = hops.select(F.col("id").alias("to"), F.col("to").alias("on"))
        hops = kept(hops.join(on, "to").select("id", F.col("on").alias("to"), (F.col("on") != F.col("to")).alias("moved")), "hops")
        if hops.where("moved").isEmpty():
            break
    names = hops.select("to").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("to")) - 1)  # k rows
    return hops.join(F.broadcast(names), "to").select("id", "cluster")


def prototypes(n: int, k: int) -> int:
    """The number of rows that are agglomerated to find k clusters of n: their pairs are then as many as k n."""
    return max(k, int(np.ceil(np.sqrt(k * n))))


def buckshot(points: DataFrame, k: int, distance: str = "l1", link: str = "average") -> DataFrame:
    """(id, cluster): agglomerate the ``prototypes`` of the least hashes, then attach all rows to the centres of these clusters."""
    m = prototypes(points.count(), k)
    chosen = kept(points.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(m), "prototypes")
    labels = cut(chosen, kept(merges(chosen, distance, link), "tree"), k)
    return attached(points, as_vectors(centres(chosen.join(labels, "id"))), distance)


def tiles(queries: DataFrame, rows: DataFrame, block: int = 500, share: int = 5000) -> tuple[DataFrame, DataFrame]:
    """The two sides of all pairs of a stated set of queries and the rows, in tiles (_a, _d) of about ``block`` queries and ``share`` rows; queries come out as (q_id, q_…)."""
    n_q, n_r = queries.count(), rows.count()
    across, down = max(1, -(-n_q // block)), max(1, -(-n_r // share))
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns], F.pmod(F.xxhash64("id"), F.lit(across)).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_d"))
    r = rows.withColumn("_d", F.pmod(F.xxhash64("id", F.lit("row")), F.lit(down)).cast("int")).withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    return q.withColumn("_d", F.col("_d").cast("int")), r


def paired(queries: DataFrame, rows: DataFrame, block: int = 500, share: int = 5000) -> DataFrame:
    """All pairs of a stated set of queries and the rows, in tiles of about ``block`` queries and ``share`` rows.

    Queries have the columns (id, …), which come out as (q_id, q_…).  Each tile
    is a key of its own, so no task holds all of either side.
    """
    q, r = tiles(queries, rows, block, share)
    return q.join(r.hint("shuffle_hash"), ["_a", "_d"]).drop("_a", "_d")


def member_links(queries: DataFrame, members: DataFrame, distance: str, how: str) -> DataFrame:
    """(id, cluster, d): the ``min``, ``max`` or ``avg`` distance of each query (id, v) to all members (id, cluster, v) of each cluster."""
    fold = {"min": F.min, "max": F.max, "avg": F.avg}[how]
    pairs = paired(queries.select("id", "v"), members.select("id", "cluster", "v"))
    return pairs.select(F.col("q_id").alias("id"), "cluster", DISTANCES[distance](F.col("q_v"), F.col("v")).alias("d")).groupBy("id", "cluster").agg(fold("d").alias("d"))


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lengths) of arrays of numbers; an array that is null or holds a null has length -1."""
    lists = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), max(int(lengths.max(initial=0)), 0)))
    at, values = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten()
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    out[at, np.arange(len(values)) - starts[at]] = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    lengths[at[pc.is_null(values).to_numpy(zero_copy_only=False)]] = -1
    return out, lengths


def row_distances(queries: DataFrame, points: DataFrame, distance: str) -> DataFrame:
    """(a, b, d): the distances of each query to each other row, once for two queries.

    ``l1`` and ``l2`` are taken a tile at a time, the components added up in their order.
    """
    asks, rows = queries.select("id", "v").withColumn("asks", F.lit(True)), points.select("id", "v").join(queries.select("id").withColumn("_asks", F.lit(True)), "id", "left")
    if distance not in ("l1", "l2"):
        pairs = paired(asks, rows)
        kept_ones = pairs.where((F.col("q_id") < F.col("id")) | ((F.col("q_id") > F.col("id")) & F.col("_asks").isNull()))
        return kept_ones.select(F.least("q_id", "id").alias("a"), F.greatest("q_id", "id").alias("b"), DISTANCES[distance](F.col("q_v"), F.col("v")).alias("d"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        (x, n), (y, m) = _vectors(left["q_v"]), _vectors(right["v"])
        width = min(x.shape[1], y.shape[1])
        d = np.zeros((len(x), len(y)))
        for k in range(width):
            apart = x[:, k, None] - y[None, :, k]
            d += np.abs(apart) if distance == "l1" else apart * apart
        known = (n[:, None] == m[None, :]) & (n > 0)[:, None]
        d /= np.maximum(n, 1)[:, None]
        q, r = left["q_id"].to_numpy()[:, None], right["id"].to_numpy()[None, :]
        asked = right["_asks"].is_valid().to_numpy()[None, :]
        i, j = np.nonzero((q < r) | ((q > r) & ~asked))
        q, r = q[i, 0], r[0, j]
        return pa.table([np.minimum(q, r), np.maximum(q, r), pa.array(d[i, j], mask=~known[i, j])], schema=pa.schema([("a", left["q_id"].type), ("b", left["q_id"].type), ("d", pa.float64())]))

    kind = points.schema["id"].dataType.simpleString()
    left, right = tiles(asks.where("id is not null"), rows.where("id is not null").withColumn("v", F.col("v").cast("array<double>")))
    left = left.withColumn("q_v", F.col("q_v").cast("array<double>"))
    return left.groupBy("_a", "_d").cogroup(right.groupBy("_a", "_d")).applyInArrow(tile, f"a {kind}, b {kind}, d double")


def weighted(distance: str, weights: list[float]):
    """``l1`` or ``l2`` with a weight for each feature; a weight of 0 masks it."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    power = {"l1": lambda x: F.abs(x), "l2": lambda x: x * x}[distance]

    def measure(a: Column, b: Column) -> Column:
        apart = F.zip_with(a, b, lambda x, y: power(x.cast("double") - y.cast("double")))
        return F.aggregate(F.zip_with(apart, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / float(sum(weights))

    return measure


def sizes(assigned: DataFrame) -> DataFrame:
    """(cluster, n, first): how many elements each cluster has, and the first of them."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def weighted_centres(points: DataFrame, memberships: DataFrame) -> DataFrame:
    """(cluster, pos, value): sums of the points (id, v) weighted by p, over the sum of p, for (id, cluster, p)."""
    each = points.select("id", F.posexplode("v").alias("pos", "x")).join(memberships.where("p is not null"), "id")
    return each.groupBy("cluster", "pos").agg((F.sum(F.col("p") * F.col("x")) / F.sum("p")).alias("value"))


def witnesses(distances: DataFrame, m: int) -> DataFrame:
    """(cluster, id, d, rank): the m points nearest to each centre, ties to the smaller id."""
    order = Window.partitionBy("cluster").orderBy("d", "id")
    return distances.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= m).select("cluster", "id", "d", "rank")


def best_centres(points: DataFrame, distances: DataFrame, m: int) -> DataFrame:
    """(cluster, pos, value): the mean of the m points nearest to each centre."""
    return centres(points.select("id", "v").join(F.broadcast(witnesses(distances, m).select("id", "cluster")), "id"))


def joint(memberships: DataFrame, weights: DataFrame) -> DataFrame:
    """(cluster, id, p): the joint distribution p(c | w) f(w) / N of memberships (id, cluster, p) and weights (id, f)."""
    whole = F.broadcast(weights.agg(F.sum("f").alias("_n")))
    return memberships.join(weights, "id").crossJoin(whole).select("cluster", "id", (F.col("p") * F.col("f") / F.col("_n")).alias("p"))


def best_map(memberships: DataFrame) -> DataFrame:
    """(id, cluster): the likeliest cluster of each element, ties to the smallest."""
    return memberships.groupBy("id").agg(F.min(F.struct((-F.col("p")).alias("p"), "cluster")).alias("m")).select("id", "m.cluster")


MEMBERSHIP = {
    "hard": "1.0",
    "linear": "dmax + dmin - d",
    "inverse": "CASE WHEN d + dmin = 0 THEN 1.0 ELSE dmin / (d + dmin) END",
    "squared_exponential": "pow(2.0, -beta * d * d / 2)",
    "exponential": "exp(-beta * d)",
    "inverse_rank": "pow(rank, -beta)",
    "fuzzy": "CASE WHEN d = 0 THEN 1 + pow(dpos, -1 / (beta - 1)) ELSE pow(d, -1 / (beta - 1)) END",
}
"""How a distance d becomes a weight; dmin, dmax and dpos (the least above 0) are over all rows, rank is that of the cluster."""


def own_first(distances: DataFrame, assigned: DataFrame, m: int) -> DataFrame:
    """The m nearest clusters of each point, its own one (id, cluster) before all others."""
    met = distances.join(assigned.select("id", F.col("cluster").alias("_own")), "id", "left")
    order = Window.partitionBy("id").orderBy((F.col("cluster") != F.col("_own")).cast("int"), "d", "cluster")
    return met.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= m).drop("_own")


def membership(distances: DataFrame, how: str, m: int, beta: float = 1.0, assigned: DataFrame | None = None) -> DataFrame:
    """(id, cluster, p): weights of each point's m nearest clusters, adding up to 1; null where all weights are 0.

    With ``assigned`` (id, cluster) a point's own cluster has the first rank.
    """
    spread = F.broadcast(distances.agg(F.min("d").alias("dmin"), F.max("d").alias("dmax"), F.min(F.when(F.col("d") > 0, F.col("d"))).alias("dpos")))
    chosen = nearest(distances, m) if assigned is None else own_first(distances, assigned, m)
    near = chosen.crossJoin(spread).withColumn("beta", F.lit(beta)).withColumn("weight", F.expr(MEMBERSHIP[how]).cast("double"))
    whole = F.sum("weight").over(Window.partitionBy("id"))
    return near.select("id", "cluster", (F.col("weight") / F.when(whole != 0, whole)).alias("p"))


def hashed_starts(points: DataFrame, k: int, runs: int) -> DataFrame:
    """(run, cluster, centre): for each of ``runs`` restarts k different points, those of the least hashes of id and run."""
    out = None
    for run in range(runs):
        chosen = points.select("id", F.col("v").alias("centre")).orderBy(F.xxhash64("id", F.lit(run)), "id").limit(k)
        named = chosen.select(F.lit(run).alias("run"), (F.row_number().over(Window.orderBy("id")) - 1).alias("cluster"), F.transform("centre", lambda x: x.cast("double")).alias("centre"))  # k rows
        out = named if out is None else out.unionByName(named)
    return out


def kmeans_runs(points: DataFrame, starts: DataFrame, distance: str = "l2", how: str = "mean", rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """((run, id, cluster, d), (run, error)): k-means, or k-medians, from all ``starts`` (run, cluster, centre) in one plan.

    Points are assigned and centres made anew until no run changes, or
    ``rounds`` times.  A run's error is the sum of its distances.  There are as
    many centres as runs and clusters, numbers that the caller sets.
    """
    from .collection import medians

    centres_now, seen = kept(starts, "starts"), None
    for left in range(rounds, 0, -1):
        pairs = points.select("id", "v").crossJoin(F.broadcast(centres_now)).select("run", "id", F.struct(F.round(DISTANCES[distance](F.col("v"), F.col("centre")), 12).alias("d"), "cluster").alias("m"))
        now = kept(pairs.groupBy("run", "id").agg(F.min("m").alias("m")).select("run", "id", "m.cluster", "m.d"), "assigned")
        digest = now.agg(F.sum(F.xxhash64("run", "id", "cluster").cast("decimal(38,0)"))).first()[0]
        if digest == seen or left == 1:
            break
        seen = digest
        each = now.join(points.select("id", F.posexplode("v").alias("pos", "x")), "id").select("run", "cluster", "pos", F.col("x").cast("double").alias("x"))
        by = ["run", "cluster", "pos"]
        middle = each.groupBy(*by).agg(F.avg("x").alias("value")) if how == "mean" else medians(each, by, "x").withColumnRenamed("median", "value")
        made = middle.groupBy("run", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("centre"))
        centres_now = kept(made, "centres")
    return now, now.groupBy("run").agg(F.sum("d").alias("error"))


def best_run(assigned: DataFrame, errors: DataFrame) -> DataFrame:
    """(id, cluster) of the run with the least error, ties to the first."""
    first = errors.agg(F.min(F.struct(F.round("error", 9).alias("error"), "run")).alias("m")).select("m.run")
    return assigned.join(F.broadcast(first), "run").select("id", "cluster")
