"""Distributions: tables of events with a weight f."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import kept
from .corpus import UNKNOWN
from .dictionary import indexed


def added(*dists: DataFrame) -> DataFrame:
    """The sum of distributions over the same event columns."""
    events = [c for c in dists[0].columns if c != "f"]
    out = dists[0]
    for d in dists[1:]:
        out = out.unionByName(d)
    return out.groupBy(*events).agg(F.sum("f").alias("f"))


def marginal(dist: DataFrame, *events: str) -> DataFrame:
    return dist.groupBy(*events).agg(F.sum("f").alias("f"))


def normalized(dist: DataFrame, *given: str) -> DataFrame:
    """p = f / total, or / the total of the rows that agree in ``given``; zero totals stay."""
    if given:  # partial sums and a join, which can be split where a value of ``given`` is hot
        dist = kept(dist, "given")
        whole = dist.groupBy(*given).agg(F.sum("f").alias("_all"))
        return dist.join(whole, list(given)).withColumn("p", F.col("f") / F.when(F.col("_all") != 0, F.col("_all"))).drop("_all")
    whole = dist.agg(F.sum("f").alias("_all"))
    return dist.crossJoin(F.broadcast(whole)).withColumn("p", F.when(F.col("_all") != 0, F.col("f") / F.col("_all")).otherwise(F.col("f"))).drop("_all")


def by_value(dist: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Events of a weight from ``low`` to ``high``, both included."""
    out = dist if low is None else dist.where(F.col("f") >= low)
    return out if high is None else out.where(F.col("f") <= high)


def by_rank(dist: DataFrame, low: int, high: int, shared: bool, event: str = "w") -> DataFrame:
    """Events ranked ``low`` to ``high`` (from 1) by falling weight; with ``shared`` ranks ties have one rank."""
    ranked = shared_ranks(dist) if shared else unique_ranks(dist, event)
    return ranked.where(F.col("rank").between(low, high)).select(*dist.columns)


def folded(dist: DataFrame, keep, event: str = "w", into: str = UNKNOWN) -> DataFrame:
    """Events that fail ``keep`` are one event, whose weight replaces what that event had before."""
    name = F.when(keep, F.col(event)).otherwise(F.lit(into))
    return dist.where((F.col(event) != into) | ~keep).groupBy(name.alias(event)).agg(F.sum("f").alias("f"))


def count_counts(dist: DataFrame) -> DataFrame:
    """(r, nr): how many events have each weight."""
    return dist.groupBy(F.col("f").alias("r")).agg(F.count("*").alias("nr"))


def entropy(dist: DataFrame, *by: str):
    """(by…, h): -sum p log2 p, from sums of f and f log2 f alone."""
    positive = dist.where("f > 0").groupBy(*by).agg(F.sum("f").alias("n"), F.sum(F.col("f") * F.log2("f")).alias("s"))
    return positive.select(*by, (F.log2("n") - F.col("s") / F.col("n")).alias("h"))


def mutual_information(dist: DataFrame, x: str, y: str) -> DataFrame:
    """(mi): H(x) + H(y) - H(x, y)."""
    parts = [entropy(marginal(dist, x)), entropy(marginal(dist, y)), entropy(dist)]
    hx, hy, hxy = (p.withColumnRenamed("h", f"h{i}") for i, p in enumerate(parts))
    return hx.crossJoin(hy).crossJoin(hxy).select((F.col("h0") + F.col("h1") - F.col("h2")).alias("mi"))


def divergence(p: DataFrame, q: DataFrame, event: str = "w") -> DataFrame:
    """(kl, common, differ): sum p log2 p/q over common events, and whether some event is in one only (then the divergence is infinite)."""
    a, b = normalized(p).select(event, F.col("p").alias("pa")), normalized(q).select(event, F.col("p").alias("pb"))
    met = a.join(b, event, "full")
    part = F.when(F.col("pa").isNotNull() & F.col("pb").isNotNull(), F.col("pa") * F.log2(F.col("pa") / F.col("pb")))
    return met.agg(F.sum(part).alias("kl"), F.count(part).alias("common"), F.max((F.col("pa").isNull() | F.col("pb").isNull()).cast("int")).alias("differ"))


def unique_ranks(dist: DataFrame, event: str = "w") -> DataFrame:
    """rank from 1 by falling weight, ties in the order of the events."""
    return indexed(dist, [F.desc("f"), event], "rank", 1)


def _levels(dist: DataFrame) -> DataFrame:
    """(f, many, dense, below): for each weight the events of it, its dense rank and the events of larger weight."""
    order = Window.orderBy(F.desc("f"))  # one row for each different weight
    return dist.groupBy("f").agg(F.count("*").alias("many")).select("f", "many", F.row_number().over(order).cast("long").alias("dense"), (F.sum("many").over(order) - F.col("many")).alias("below"))


def shared_ranks(dist: DataFrame) -> DataFrame:
    """rank from 1 by falling weight; ties have one rank and none is left out."""
    return dist.join(_levels(dist).select("f", F.col("dense").alias("rank")), "f").select(*dist.columns, "rank")


def average_ranks(dist: DataFrame) -> DataFrame:
    """rank from 0 by falling weight; ties have their mean rank."""
    return dist.join(_levels(dist).select("f", (F.col("below") + (F.col("many") - 1) / 2).alias("rank")), "f").select(*dist.columns, "rank")


def quanta(ranked: DataFrame, n: int) -> DataFrame:
    """Ranks, falling, on a scale of 0 to ``n``, rounded half up."""
    most = ranked.agg(F.max("rank").alias("_m"))
    return ranked.crossJoin(F.broadcast(most)).withColumn("quantum", F.floor((1 + F.col("_m") - F.col("rank")) / F.col("_m") * n + 0.5).cast("long")).drop("_m")


def smeared(counts: DataFrame) -> DataFrame:
    """(r, nr, z): nr spread over the gap to the neighbouring r, as Good-Turing fits want it."""
    order = Window.orderBy("r")  # one row for each different count
    low = F.coalesce(F.lag("r").over(order), F.lit(0))
    high = F.coalesce(F.lead("r").over(order), 2 * F.col("r") - low)
    return counts.select("r", "nr", (2 * F.col("nr") / (high - low)).alias("z"))


def good_turing(dist: DataFrame) -> DataFrame:
    """(r, nr, r_star): the expected count under a line fitted to log z over log r."""
    z = smeared(count_counts(dist))
    x, y = F.log(F.col("r").cast("double")), F.log("z")
    line = z.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    at = lambda r: F.exp(F.col("a") + F.col("b") * F.log(r.cast("double")))
    return z.crossJoin(F.broadcast(line)).select("r", "nr", ((F.col("r") + 1) * at(F.col("r") + 1) / at(F.col("r"))).alias("r_star"))


def missing_mass(dist: DataFrame) -> DataFrame:
    """(mass): events seen once, over all."""
    return dist.agg((F.sum(F.when(F.col("f") == 1, F.col("f")).otherwise(0)) / F.sum("f")).alias("mass"))


def expanded_prefixes(grams: DataFrame, n: int) -> DataFrame:
    """(k, g, f): all prefixes of n-grams, as arrays, with summed weights."""
    whole = F.array(*[f"w{i + 1}" for i in range(n)])
    return grams.select("f", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(k.cast("long").alias("k"), F.array_join(F.slice(whole, 1, k), "\t").alias("g")))).alias("x")).groupBy("x.k", "x.g").agg(F.sum("f").alias("f"))


def edge_expanded(grams: DataFrame, n: int, edge: str) -> DataFrame:
    """n-grams and, for those that start or end at an edge, what is seen from further out.

    A gram that starts with the edge mark is added shifted right by one to n - 2
    places with more marks before it, and one that ends with it likewise to the left.
    """
    names = [f"w{i + 1}" for i in range(n)]
    whole = F.array(*names)
    mark = lambda k: F.array_repeat(F.lit(edge), k)
    before = [F.when(F.col("w1") == edge, F.concat(mark(k), F.slice(whole, 1, n - k))) for k in range(1, n - 1)]
    after = [F.when(F.col(names[-1]) == edge, F.concat(F.slice(whole, k + 1, n - k), mark(k))) for k in range(1, n - 1)]
    out = grams.select("f", F.explode(F.filter(F.array(whole, *before, *after), lambda g: g.isNotNull())).alias("g"))
    return out.groupBy(*[F.get("g", i).alias(x) for i, x in enumerate(names)]).agg(F.sum("f").alias("f"))


def sane(grams: DataFrame, column: str, n: int, separator: str = "\t") -> DataFrame:
    """Events that are n-grams indeed."""
    return grams.where(F.size(F.split(column, separator)) == n)


def transposed(cells: DataFrame, x: str, y: str) -> DataFrame:
    return cells.select(F.col(y).alias(x), F.col(x).alias(y), *[c for c in cells.columns if c not in (x, y)])


def sliced(cells: DataFrame, fixed: dict) -> DataFrame:
    """The cells that agree in the fixed places, without these."""
    out = cells
    for c, v in fixed.items():
        out = out.where(F.col(c) == v)
    return out.drop(*fixed)


def with_missing(cells: DataFrame, dims: list[str], missing: float) -> DataFrame:
    """(cells, stored, total, mean, entropy) of a sparse table whose unstored cells all hold ``missing``."""
    sizes = None
    for d in dims:
        one = cells.agg(F.count_distinct(d).cast("double").alias(f"_{d}"))
        sizes = one if sizes is None else sizes.crossJoin(one)
    log = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    sums = cells.agg(F.count("*").alias("stored"), F.sum("f").alias("_sum"), F.sum(log(F.col("f").cast("double"))).alias("_log"))
    many = F.lit(1.0)
    for d in dims:
        many = many * F.col(f"_{d}")
    out = sums.crossJoin(sizes).withColumn("cells", many).withColumn("_rest", F.col("cells") - F.col("stored"))
    out = out.withColumn("total", F.col("_sum") + F.col("_rest") * missing).withColumn("_logs", F.col("_log") + F.col("_rest") * log(F.lit(float(missing))))
    return out.select("cells", "stored", "total", (F.col("total") / F.col("cells")).alias("mean"), (F.log2("total") - F.col("_logs") / F.col("total")).alias("entropy"))


def moments(dist: DataFrame, value, *by: str) -> DataFrame:
    """(by…, expectation, variance) of a number that depends on the event, under the weights f."""
    rows = dist.select(*by, F.col("f").cast("double").alias("f"), value.cast("double").alias("x"))
    sums = rows.groupBy(*by).agg(F.sum("f").alias("n"), F.sum(F.col("f") * F.col("x")).alias("s"), F.sum(F.col("f") * F.col("x") * F.col("x")).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select(*by, mean.alias("expectation"), (F.col("q") / F.col("n") - mean * mean).alias("variance"))


def code_lengths(dist: DataFrame, *by: str) -> DataFrame:
    """(by…, events, message, most, uniform): the bits of all events under their own distribution, the largest entropy possible, and an event's share if all were alike."""
    sums = dist.where("f > 0").groupBy(*by).agg(F.count("*").alias("events"), F.sum("f").alias("n"), F.sum(F.col("f") * F.log2("f")).alias("s"))
    return sums.select(*by, "events", (F.col("n") * F.log2("n") - F.col("s")).alias("message"), F.log2("events").alias("most"), (1 / F.col("events")).alias("uniform"))
