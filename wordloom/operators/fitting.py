"""Fits, bins and Gaussian functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import kept
from .dictionary import indexed


def line(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """(slope, intercept) by least squares."""
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def power_law(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept) of ln y over ln x, of positive values."""
    return line(rows.where((F.col(x) > 0) & (F.col(y) > 0)), F.log(F.col(x).cast("double")), F.log(F.col(y).cast("double")))


def zipf_constant(ranked: DataFrame) -> DataFrame:
    """(c): the least-squares c of f = c / rank."""
    inverse = 1 / F.col("rank").cast("double")
    return ranked.agg((F.sum(F.col("f") * inverse) / F.sum(inverse * inverse)).alias("c"))


def log_bins(rows: DataFrame, x: str, y: str, base: float = 2.0) -> DataFrame:
    """(bin, n, mean, deviation): y in bins of equal width of the logarithm of x."""
    bin_of = F.floor(F.log(F.col(x).cast("double")) / F.log(F.lit(base)) + 1e-9).cast("long")
    return rows.where(F.col(x) > 0).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("deviation"))


def gaussian_fit(rows: DataFrame, x: str) -> DataFrame:
    """(mean, deviation, peak): the height of the density is 1 / (deviation sqrt(2 pi))."""
    return rows.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation")).withColumn("peak", 1 / (F.col("deviation") * F.sqrt(2 * F.pi())))


def gaussian_density(x: Column, mean: Column, deviation: Column) -> Column:
    z = (x - mean) / deviation
    return F.exp(-z * z / 2) / (deviation * F.sqrt(2 * F.pi()))


def standardized(x: Column, mean: Column, deviation: Column) -> Column:
    return (x - mean) / F.when(deviation != 0, deviation)


def order_medians(rows: DataFrame, x: str, tie: str) -> DataFrame:
    """(x, m): each value with the median of its place among as many uniform ones."""
    placed = indexed(rows.where(F.col(x).isNotNull()).select(x, tie), [x, tie], "place", 1)
    n = F.broadcast(placed.agg(F.count("*").cast("double").alias("_n")))
    last = F.pow(F.lit(0.5), 1 / F.col("_n"))
    m = F.when(F.col("place") == F.col("_n"), last).when(F.col("place") == 1, 1 - last).otherwise((F.col("place") - 0.3175) / (F.col("_n") + 0.365))
    return placed.crossJoin(n).select(x, tie, m.alias("m"))


def covariances(points: DataFrame, vector: str = "v") -> DataFrame:
    """(i, j, covariance) of the components of vectors of one length: sums of products, of which there are as many as pairs of components."""
    at = points.select(F.col(vector).alias("v"), F.posexplode(vector).alias("i", "x"))
    pairs = at.select("i", "x", F.posexplode("v").alias("j", "y"))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return pairs.groupBy("i", "j").agg((F.avg(x * y) - F.avg(x) * F.avg(y)).alias("covariance"))


def rank_sums(rows: DataFrame, group: str, x: str) -> DataFrame:
    """(group, n, w, u, z): sums of the mean ranks of a group's values among all, and how far they are from chance (Wilcoxon)."""
    counts = rows.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("f")).agg(F.count("*").alias("_many"))
    # Sums of the smaller values' counts, by range and place.
    part = kept(counts.repartitionByRange("f").withColumn("_part", F.spark_partition_id()), "ranks")
    before = part.groupBy("_part").agg(F.sum("_many").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.sum("_many").over(Window.partitionBy("_part").orderBy("f").rowsBetween(Window.unboundedPreceding, -1))
    ranks = part.withColumn("_own", F.coalesce(own, F.lit(0))).join(before.select("_part", "_before"), "_part")
    ranks = ranks.select(F.col("f").alias(x), (F.col("_before") + F.col("_own") + (F.col("_many") + 1) / 2).alias("_rank"))
    sums = rows.join(ranks, x).groupBy(group).agg(F.count("*").cast("double").alias("n"), F.sum("_rank").alias("w"))
    whole = F.broadcast(counts.agg(F.sum("_many").cast("double").alias("_all")))
    n, rest = F.col("n"), F.col("_all") - F.col("n")
    u = F.col("w") - n * (n + 1) / 2
    return sums.crossJoin(whole).select(group, "n", "w", u.alias("u"), ((u - n * rest / 2) / F.sqrt(n * rest * (F.col("_all") + 1) / 12)).alias("z"))


def offset_power_law(rows: DataFrame, x: str, y: str, rounds: int = 60) -> tuple[float, float, float, float]:
    """(a, b, c, sum of squares) of y = a x^b + c by damped Gauss-Newton steps; x must be above 0.

    Each step needs the sums of ten products over the rows, by one aggregate.
    """
    import numpy as np

    given = kept(rows.where((F.col(x) > 0) & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "points")
    start = given.agg(F.min("y").alias("low"), F.max("y").alias("high"), F.min("x").alias("first"), F.max("x").alias("last"), F.corr("x", "y").alias("r"), F.count("*").alias("n")).first()
    if start["n"] < 3:
        raise ValueError("three points are needed")

    def sums(p) -> tuple[np.ndarray, np.ndarray, float]:
        a, b, c = (float(v) for v in p)
        power = F.pow("x", F.lit(b))
        parts = [power, a * power * F.log("x"), F.lit(1.0)]
        rest = F.col("y") - (a * power + c)
        wanted = [F.sum(parts[i] * parts[j]).alias(f"g{i}{j}") for i in range(3) for j in range(i, 3)] + [F.sum(parts[i] * rest).alias(f"r{i}") for i in range(3)] + [F.sum(rest * rest).alias("s")]
        got = given.agg(*wanted).first()
        g = np.array([[got[f"g{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
        return g, np.array([got[f"r{i}"] for i in range(3)]), got["s"]

    def best_of(b: float) -> tuple[float, np.ndarray]:
        """For a given power the other two are linear."""
        g, r, s = sums((0.0, b, 0.0))
        g, r = g[np.ix_([0, 2], [0, 2])], r[[0, 2]]
        a, c = np.linalg.lstsq(g, r, rcond=None)[0]
        return s - float(np.array([a, c]) @ r), np.array([a, b, c])

    _, p = min((best_of(b) for b in (-3.0, -2.0, -1.0, -0.5, 0.5, 1.0, 2.0, 3.0)), key=lambda z: z[0])
    damp = 1e-3
    g, r, s = sums(p)
    for _ in range(rounds):
        step = np.linalg.lstsq(g + damp * np.diag(np.maximum(np.diag(g), 1e-12)), r, rcond=None)[0]
        g2, r2, s2 = sums(p + step)
        if np.isfinite(s2) and s2 <= s:
            done = np.abs(step).max() <= 1e-12 * max(1.0, np.abs(p).max())
            p, g, r, s, damp = p + step, g2, r2, s2, max(damp / 10, 1e-12)
            if done:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    return float(p[0]), float(p[1]), float(p[2]), float(s)


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often it is used: as the argument of a lambda function."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def erf(x: Column) -> Column:
    """The error function to about 1e-14: a series within 3 of 0, a continued fraction beyond."""
    return _bound(x, lambda y: F.signum(y) * _bound(F.abs(y), lambda z: F.when(z <= 3, _bound(F.least(z, F.lit(3.0)), _near)).otherwise(1 - _bound(F.greatest(z, F.lit(3.0)), _tail))))


def _near(z: Column) -> Column:
    # 2 / sqrt(pi) exp(-z^2) z (1 + 2 z^2 / 3 + (2 z^2)^2 / (3 5) + …)
    term = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda acc, k: _next_term(acc, k, z))
    return 2 / F.sqrt(F.pi()) * F.exp(-z * z) * z * term["s"]


def _tail(z: Column) -> Column:
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda acc, k: z + (k / 2.0) / acc)
    return F.exp(-z * z) / (F.sqrt(F.pi()) * fraction)


def _next_term(acc: Column, k: Column, z: Column) -> Column:
    t = acc["t"] * 2 * z * z / (2 * k + 1)
    return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))


def gaussian_cdf(x: Column, mean: Column | float = 0.0, deviation: Column | float = 1.0) -> Column:
    return (1 + erf((x - mean) / (deviation * F.sqrt(F.lit(2.0))))) / 2


# P. J. Acklam's rational approximation of the inverse normal distribution.
_CENTRE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def gaussian_quantile(p: Column, mean: Column | float = 0.0, deviation: Column | float = 1.0) -> Column:
    """The value below which a share p of a normal distribution lies, infinite at 0 and 1, null beyond."""
    return _bound(p, lambda share: _bound(F.least(share, 1 - share), lambda low: _quantile(share, low))) * deviation + mean


def _quantile(p: Column, low: Column) -> Column:
    """That of the standard normal distribution at p, ``low`` being the lesser of p and 1 - p."""
    centre = _bound(low - 0.5, lambda q: _polynomial(_CENTRE, q * q) * q / _polynomial(_CENTRE_BELOW, q * q))
    tail = _bound(F.sqrt(-2 * F.log(low)), lambda t: _polynomial(_TAIL, t) / _polynomial(_TAIL_BELOW, t))

    def better(first: Column) -> Column:
        # One step of Halley's method.
        return _bound((gaussian_cdf(first) - low) * F.sqrt(2 * F.pi()) * F.exp(first * first / 2), lambda error: first - error / (1 + first * error / 2))

    def ends(z: Column) -> Column:
        return F.when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf"))).when((p > 0) & (p < 1), F.when(p <= 0.5, z).otherwise(-z))

    return _bound(_bound(F.when(low < 0.02425, tail).otherwise(centre), lambda first: F.when(low > 1e-10, better(first)).otherwise(first)), ends)


def probit(p: Column) -> Column:
    """The quantile of the standard normal distribution."""
    return gaussian_quantile(p)
