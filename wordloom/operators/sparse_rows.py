"""Distances, centres and k-means of sparse rows: tables (t, k, x) of a row's name, a feature and its value above 0.

Nothing dense is made: a distance is a join of the features that two rows share
and two sums.  Centres are as many as clusters, with the features that a caller
chose, so they are the small side of each join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import kept

BROADCAST = 1_000_000
"""Most cells of centres that are broadcast; more are joined by a shuffle."""
DIGITS = 9
"""Decimal places of a distance; what is alike in all of them is a tie."""

_SUMS = {"l1": "x", "l2": "x * x", "cosine": "x * x"}
_SHARED = {"l1": "abs(x - y) - x - y", "l2": "-2 * x * y", "cosine": "x * y"}


def shares(cells: DataFrame) -> DataFrame:
    """(t, k, x): a profile (dir, t, b, f) as the distributions of each target's neighbours on either side; a feature names side and bound."""
    whole = cells.groupBy("dir", "t").agg(F.sum("f").alias("whole")).where("whole > 0")
    return cells.where("f > 0").join(whole, ["dir", "t"]).select("t", F.concat_ws(":", "dir", "b").alias("k"), (F.col("f") / F.col("whole")).alias("x"))


def distances(rows: DataFrame, centres: DataFrame, how: str = "l1") -> DataFrame:
    """(t, c, d): the distance of each row to each centre (c, k, x): ``l1`` and ``l2`` (squared) as sums over the features, ``cosine`` as 1 less the cosine."""
    size, shared = F.expr(_SUMS[how]), F.expr(_SHARED[how])
    theirs = {r["c"]: r["b"] for r in centres.groupBy("c").agg(F.sum(size).alias("b")).orderBy("c").collect()}  # a row for each centre
    names = list(theirs)
    if not names:
        return rows.select("t", F.lit(None).cast(centres.schema["c"].dataType).alias("c"), F.lit(None).cast("double").alias("d")).where("false")
    few = centres.limit(BROADCAST + 1).count() <= BROADCAST
    # All centres' values of a feature side by side, so that a cell of a row meets them once; 0 adds nothing.
    side = centres.groupBy("k").agg(*[F.coalesce(F.sum(F.when(F.col("c") == c, F.col("x"))), F.lit(0.0)).alias(f"y{i}") for i, c in enumerate(names)])
    both = rows.join(F.broadcast(side) if few else side, "k", "left")
    sums = [F.coalesce(F.sum(F.expr(_SHARED[how].replace("y", f"y{i}"))), F.lit(0.0)).alias(f"s{i}") for i in range(len(names))]
    met = both.groupBy("t").agg(F.sum(size).alias("a"), *sums)
    # Every row meets every centre, also those of which it shares no feature.
    each = F.array(*[F.struct(F.lit(c).cast(centres.schema["c"].dataType).alias("c"), F.lit(b).alias("b"), F.col(f"s{i}").alias("s")) for i, (c, b) in enumerate(theirs.items())])
    met = met.select("t", "a", F.explode(each).alias("x")).select("t", "a", "x.*")
    d = 1 - F.col("s") / F.sqrt(F.col("a") * F.col("b")) if how == "cosine" else F.col("a") + F.col("b") + F.col("s")
    return met.select("t", "c", F.round(F.greatest(d, F.lit(0.0)), DIGITS).alias("d"))


def nearest(found: DataFrame) -> DataFrame:
    """(t, c, d): each row's nearest centre, ties to the smaller one."""
    return found.groupBy("t").agg(F.min(F.struct("d", "c")).alias("m")).select("t", "m.c", "m.d")


def means(rows: DataFrame, own: DataFrame) -> DataFrame:
    """(c, k, x): the mean of the rows of each cluster (t, c)."""
    sizes = own.groupBy("c").agg(F.count("*").alias("n"))
    return rows.join(own.select("t", "c"), "t").groupBy("c", "k").agg(F.sum("x").alias("x")).join(F.broadcast(sizes), "c").select("c", "k", (F.col("x") / F.col("n")).alias("x"))


def started(rows: DataFrame, weights: DataFrame, k: int, first: int = 0) -> DataFrame:
    """(c, k, x): the rows of the ``k`` heaviest targets (w, f) as centres, numbered from ``first`` by falling weight."""
    known = weights.join(rows.select(F.col("t").alias("w")).distinct(), "w", "left_semi").orderBy(F.desc("f"), "w").limit(k)
    order = Window.orderBy(F.desc("f"), "w")  # k rows
    named = known.select(F.col("w").alias("t"), (F.row_number().over(order) + (first - 1)).alias("c"))
    return rows.join(F.broadcast(named), "t").select("c", "k", "x")


def kmeans(rows: DataFrame, start: DataFrame, rounds: int, how: str = "l1") -> tuple[DataFrame, DataFrame]:
    """((t, c, d), centres): rows assigned to their nearest centre and centres to their rows' mean, ``rounds`` times or until nothing changes."""
    centres, seen = kept(start, "centres"), None
    for left in range(rounds, 0, -1):
        own = kept(nearest(distances(rows, centres, how)), "assigned")
        digest = own.agg(F.sum(F.xxhash64("t", "c").cast("decimal(38,0)"))).first()[0]
        if digest == seen or left == 1:
            break
        seen = digest
        centres = kept(means(rows, own), "centres")
    return own, centres
