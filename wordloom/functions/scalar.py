"""Scalar functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_or_zero(x: Column, zero: float = 0.0) -> Column:
    """Base-2 logarithm; ``zero`` where it is not finite."""
    return F.when(x > 0, F.log2(x)).otherwise(F.lit(zero))


def log_or_zero(x: Column, base: float | None = None, zero: float = 0.0) -> Column:
    """The logarithm to a base, natural without one; ``zero`` where it is not finite."""
    return F.when(x > 0, F.log(x) if base is None else F.log(float(base), x)).otherwise(F.lit(zero))


def log_add(x: Column, y: Column) -> Column:
    """ln(e^x + e^y) without overflow."""
    return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))


def log_difference(x: Column, y: Column) -> Column:
    """ln|e^x - e^y| without overflow; null where both are equal."""
    return F.when(x != y, F.greatest(x, y) + F.log1p(-F.exp(-F.abs(x - y))))


def log_factorial(n: Column) -> Column:
    """ln n!: a sum up to 20, Stirling's series beyond."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3)))
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def log_binomial(n: Column, k: Column) -> Column:
    """ln C(n, k)."""
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def binomial_probability(n: Column, k: Column, p: Column) -> Column:
    """C(n, k) p^k (1-p)^(n-k)."""
    return F.exp(log_binomial(n, k)) * F.pow(p, k) * F.pow(1 - p, n - k)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def minkowski(a: Column, b: Column, p: float) -> Column:
    """(sum |a-b|^p)^(1/p) of two arrays."""
    parts = F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y.cast("double")), F.lit(p)))
    return F.pow(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(1.0 / p))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def run_lengths(a: Column) -> Column:
    """Run-length code of an array of long: structs (value, many) in order."""
    empty = F.array().cast("array<struct<value:bigint,many:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        more = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(x.alias("value"), (last["many"] + 1).alias("many"))))
        new = F.concat(acc, F.array(F.struct(x.alias("value"), F.lit(1).cast("bigint").alias("many"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["value"] == x), more).otherwise(new)

    return F.aggregate(a.cast("array<bigint>"), empty, step)


def plain_name(c: Column) -> Column:
    """A title as a column name: every run of other characters becomes one underscore."""
    return F.regexp_replace(c, r"\W+", "_")


def canonical_key(m: Column) -> Column:
    """A map as text: its entries in the order of their keys."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("=>"), F.coalesce(e["value"], F.lit("")))), " && ")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def as_weight(p: Column) -> Column:
    """A probability as the weight of an arc: -ln p."""
    return -F.log(p)


def as_probability(weight: Column) -> Column:
    return F.exp(-weight)


def short_first(text: Column) -> list[Column]:
    """Sort keys: the length of a text, then the text."""
    return [F.length(text), text]


def filtered(values: Column, q: float) -> Column:
    """An array smoothed exponentially from both ends: the mean of both passes, each s = q x + (1 - q) s, starting from its first value."""
    def one(a: Column) -> Column:
        step = lambda s, x: F.concat(s, F.array(F.when(F.size(s) == 0, x).otherwise(q * x + (1 - q) * F.element_at(s, -1))))
        return F.aggregate(a, F.array().cast("array<double>"), step)

    return F.zip_with(one(values), F.reverse(one(F.reverse(values))), lambda x, y: (x + y) / 2)
