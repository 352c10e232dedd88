"""Semi-structured records: selection, grouping, set operations and the aggregates of groups.

A record is a row with a map ``uvars`` of its variables, all text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import canonical_key
from ..functions.storage import kept


def keyed(records: DataFrame, column: str = "uvars") -> DataFrame:
    """With ``key``, the canonical text of a record's variables."""
    return records.withColumn("key", canonical_key(F.col(column)))


def selected(records: DataFrame, predicate: str | Column) -> DataFrame:
    """Records for which a predicate holds; text is a SQL expression, never code."""
    return records.where(F.expr(predicate) if isinstance(predicate, str) else predicate)


def only(records: DataFrame, names: list[str]) -> DataFrame:
    """Records whose variables are cut to those named."""
    return records.withColumn("uvars", F.map_filter("uvars", lambda k, v: k.isin(*names)))


def projected(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns in order; unknown names are left out."""
    return rows.select(*[c for c in columns if c in rows.columns])


def members(records: DataFrame, names: list[str]) -> DataFrame:
    """Records with the variables that group them as columns; a missing one counts as empty text.

    A group is the rows that agree in these columns: it is never gathered in
    one place, however large.
    """
    return keyed(records).withColumns({n: F.coalesce(F.try_element_at("uvars", F.lit(n)), F.lit("")) for n in names})


def grouped(records: DataFrame, names: list[str]) -> DataFrame:
    """(names…, n, first): the groups, how many records each has, and the first of their keys."""
    return members(records, names).groupBy(*names).agg(F.count("*").alias("n"), F.min("key").alias("first"))


def grouped_over(records: DataFrame, over: list[str], known: list[str]) -> DataFrame:
    """Groups of records that agree in all known variables but those in ``over``."""
    return grouped(records, [n for n in known if n not in over])


def ungrouped(grouped_members: DataFrame, names: list[str]) -> DataFrame:
    """The members of groups as records again."""
    return grouped_members.drop("key", *names)


def common_value(column: Column) -> Column:
    """The one value that all members share, or null; null, empty text and 0 are one value."""
    plain = F.when(column.isNull() | (column.cast("string") == "0"), F.lit("")).otherwise(column.cast("string"))
    return F.when(F.min(plain) == F.max(plain), F.max(column))


def clobbered(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All of ``right``, and what of ``left`` has another key."""
    return right.unionByName(left.join(right.select(key), key, "left_anti").select(right.columns))


def removed(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def mixed_order(column: Column) -> list[Column]:
    """Sort keys of text values: missing ones first, then numbers by size, then other text."""
    number = column.try_cast("double")
    return [column.isNotNull(), number.isNull(), number, column]


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "min": F.min,
    "max": F.max,
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0)),
    "prod": lambda x: F.coalesce(F.product(x), F.lit(1.0)),
    "count": lambda x: F.count(F.lit(1)),
    "nvalues": lambda x: F.count_distinct(F.coalesce(x.cast("string"), F.lit(""))),
    "ndefined": F.count,
    "nnz": lambda x: F.count_if(F.coalesce(x != 0, F.lit(False))),
    "avg": lambda x: F.coalesce(F.avg(x), F.lit(0.0)),
    "var": lambda x: F.coalesce(F.var_pop(x), F.lit(0.0)),
    "stddev": lambda x: F.coalesce(F.stddev_pop(x), F.lit(0.0)),
    "med": lambda x: F.coalesce(F.median(x), F.lit(0.0)),
    "mvar": lambda x: F.coalesce(F.abs(F.avg(x * x) - F.pow(F.median(x), F.lit(2))), F.lit(0.0)),
    "mdev": lambda x: F.coalesce(F.sqrt(F.abs(F.avg(x * x) - F.pow(F.median(x), F.lit(2)))), F.lit(0.0)),
}
"""Aggregates as expressions; a group function without a name is ``max``.  ``aggregated`` takes the last three from ``medians``, whatever a group's size."""


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by…, median): from the counts of a group's values, so that no group is gathered in one place.

    Values are put in order by range over all groups; the running count of a
    value is that of the ranges before it and of the values before it in its own.
    """
    group = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in by])
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    order = [*by, "_x"]
    placed = kept(counts.withColumn("_g", group).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "values")
    parts = placed.groupBy("_g", "_part").agg(F.sum("_n").alias("_in"))
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = parts.withColumn("_before", F.coalesce(F.sum("_in").over(earlier), F.lit(0))).drop("_in")
    totals = parts.groupBy("_g").agg(F.sum("_in").alias("_all"))
    within = Window.partitionBy("_g", "_part").orderBy("_x")
    met = placed.withColumn("_to", F.sum("_n").over(within)).join(before, ["_g", "_part"]).join(totals, "_g").withColumn("_to", F.col("_to") + F.col("_before"))
    holds = lambda k: (F.col("_to") - F.col("_n") < k) & (F.col("_to") >= k)
    low, high = F.ceil(F.col("_all") / 2), F.floor(F.col("_all") / 2) + 1
    return met.groupBy(*by).agg(((F.max(F.when(holds(low), F.col("_x"))) + F.max(F.when(holds(high), F.col("_x")))) / 2).alias("median"))


def deviations(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by…, avgdev, amdev): the mean distance from the mean and from the median; a group of nulls has neither."""
    middle = rows.groupBy(*by).agg(F.avg(value).alias("_m")).join(medians(rows, by, value).withColumnRenamed("median", "_d"), by, "left")
    return rows.join(middle, by).groupBy(*by).agg(F.coalesce(F.avg(F.abs(F.col(value) - F.col("_m"))), F.lit(0.0)).alias("avgdev"), F.coalesce(F.avg(F.abs(F.col(value) - F.col("_d"))), F.lit(0.0)).alias("amdev"))


def aggregated(rows: DataFrame, by: list[str], value: str, names: list[str]) -> DataFrame:
    """The named aggregates of a numeric column for each group."""
    plain = [AGGREGATES[n](F.col(value)).alias(n) for n in names if n in AGGREGATES]
    if set(names) & {"med", "mvar", "mdev"}:  # from the median and the mean square
        rows = kept(rows, "rows")
        square = rows.groupBy(*by).agg(F.avg(F.col(value) * F.col(value)).alias("_square"))
        spread = F.abs(F.col("_square") - F.col("median") * F.col("median"))
        own = {"med": F.col("median"), "mvar": spread, "mdev": F.sqrt(spread)}
        middle = square.join(medians(rows, by, value), by, "left").select(*by, *[F.coalesce(own[n], F.lit(0.0)).alias(n) for n in names if n in own])
        others = [n for n in names if n not in own]
        return (middle.join(aggregated(rows, by, value, others), by) if others else middle).select(*by, *names)
    far = deviations(rows, by, value) if set(names) & {"avgdev", "amdev"} else None
    if not plain:
        return far.select(*by, *names)
    out = rows.groupBy(*by).agg(*plain)
    return (out if far is None else out.join(far, by)).select(*by, *names)


def first_of_each(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key, as a listing without repeats gives it."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def flattened(records: DataFrame, names: list[str]) -> DataFrame:
    """(path, key): the members of nested groups, outer names first; a member's path is its groups' values."""
    return members(records, names).select(F.concat_ws("/", *names).alias("path"), "key")


def path_counts(records: DataFrame, names: list[str]) -> DataFrame:
    """(depth, path, n, children): every group of every level, with its members and the groups right below it."""
    rows = members(records, names)
    levels = [F.struct(F.lit(k).alias("depth"), F.concat_ws("/", *names[:k]).alias("path"), (F.col(names[k]) if k < len(names) else F.lit(None).cast("string")).alias("child")) for k in range(1, len(names) + 1)]
    return rows.select(F.explode(F.array(*levels)).alias("x")).groupBy("x.depth", "x.path").agg(F.count("*").alias("n"), F.count_distinct("x.child").alias("children"))


def upserted(records: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The records, and those wanted whose key none of them has."""
    return records.unionByName(wanted.join(records.select(key), key, "left_anti").select(records.columns))
