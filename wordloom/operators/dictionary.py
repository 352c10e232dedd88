"""Dictionaries: symbols, dense ids and translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import kept


def indexed(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """A dense id in the given order, without gathering all rows in one task.

    Rows are sorted by range; a row's id is the number of rows in the ranges
    before it, plus its place in its own.
    """
    placed = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "indexed")
    part, within = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.withColumn("_part", part).join(before, "_part").withColumn(name, within + F.col("_before") + start).drop("_part", "_before", "_at")


def dictionary(symbols: DataFrame, column: str) -> DataFrame:
    """(sym, id): the different symbols, numbered from 0 in their order."""
    return indexed(symbols.select(F.col(column).alias("sym")).where("sym is not null").distinct(), ["sym"], "id")


def compacted(enum: DataFrame) -> DataFrame:
    """(sym, id, old_id): ids without holes, in the old order."""
    return indexed(enum.select("sym", F.col("id").alias("old_id")), ["old_id"], "id")


def translated(left: DataFrame, right: DataFrame, bad: int | None = None) -> DataFrame:
    """(id, other_id): the id of each symbol in another dictionary; ``bad`` (its size + 1 by default) where it has none."""
    default = F.lit(bad) if bad is not None else F.col("_bad")
    size = right.agg((F.count("*") + 1).alias("_bad"))
    return left.join(right.select("sym", F.col("id").alias("_id")), "sym", "left").crossJoin(F.broadcast(size)).select("sym", "id", F.coalesce("_id", default).cast("long").alias("other_id"))


def united(left: DataFrame, right: DataFrame) -> DataFrame:
    return dictionary(left.select("sym").unionByName(right.select("sym")), "sym")


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("sym"), "sym", "left_anti")


def nary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(columns…, id, id_<column>…): an id for each different tuple, and that of each of its parts in one dictionary of all parts."""
    parts = None
    for c in columns:
        one = rows.select(F.col(c).alias("sym"))
        parts = one if parts is None else parts.unionByName(one)
    enum = kept(dictionary(parts, "sym"), "parts")
    out = indexed(rows.select(*columns).distinct(), columns, "id")
    for c in columns:
        out = out.join(enum.select(F.col("sym").alias(c), F.col("id").alias(f"id_{c}")), c)
    return out.select(*columns, "id", *[f"id_{c}" for c in columns])


def flat(tuples: DataFrame, columns: list[str], size: int) -> DataFrame:
    """With ``flat``: one number for a tuple of ids below ``size``, the last one running fastest."""
    number = F.lit(0).cast("long")
    for c in columns:
        number = number * size + F.col(c)
    return tuples.withColumn("flat", number)


def unflat(flats: DataFrame, columns: list[str], size: int) -> DataFrame:
    """The ids that flat numbers were made of."""
    return flats.withColumns({c: F.pmod(F.floor(F.col("flat") / F.lit(size ** (len(columns) - 1 - k))), F.lit(size)).cast("long") for k, c in enumerate(columns)})


def vectors(rows: DataFrame, column: str) -> DataFrame:
    """(sym, id): the different integer vectors, numbered in lexicographic order."""
    return dictionary(rows, column)


def recoded(symbols: DataFrame, column: str, source: str, to: str) -> DataFrame:
    """Symbols whose bytes in one character set are read in another."""
    return symbols.withColumn(column, F.decode(F.encode(F.col(column), source), to))


def grown(enum: DataFrame, symbols: DataFrame) -> DataFrame:
    """(sym, id): a dictionary of symbols or vectors with the new ones of ``symbols`` (sym) behind the old, in their order; old ids stay."""
    new = kept(symbols.select("sym").where("sym is not null").distinct().join(enum.select("sym"), "sym", "left_anti"), "symbols")
    last = enum.agg(F.max("id").alias("m")).first()["m"]
    return enum.select("sym", "id").unionByName(indexed(new, ["sym"], "id", 0 if last is None else last + 1).select("sym", "id"))


def forced(enum: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sym, id) with the ids that ``pairs`` (sym, id) force: a symbol's old id and an id's old symbol go; of several ids for a symbol, and of several symbols for an id, the least stays."""
    once = kept(pairs.groupBy("sym").agg(F.min("id").alias("id")).groupBy("id").agg(F.min("sym").alias("sym")).select("sym", "id"), "forced")
    rest = enum.select("sym", "id").join(once.select("sym"), "sym", "left_anti").join(once.select("id"), "id", "left_anti")
    return rest.select("sym", "id").unionByName(once)
