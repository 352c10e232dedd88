"""Profiles re-shaped by smoothing, fitted frequencies, ranks, weights and trigram slots.

Profiles are tables (dir, t, b, f); dense ones hold a row for every pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dictionary import indexed


def _spread_counts(profile: DataFrame) -> DataFrame:
    """(dir, r, nr, z) of the weights above 0: counts of counts spread over the gaps between them."""
    counts = profile.where("f > 0").groupBy("dir", F.col("f").alias("r")).agg(F.count("*").alias("nr"))
    order = Window.partitionBy("dir").orderBy("r")  # one row for each different weight
    low = F.coalesce(F.lag("r").over(order), F.lit(0.0))
    high = F.coalesce(F.lead("r").over(order), 2 * F.col("r") - low)
    return counts.select("dir", "r", "nr", (2 * F.col("nr") / (high - low)).alias("z"))


def good_turing_profile(dense: DataFrame) -> DataFrame:
    """Weights r become (r + m) E(r + m) / E(r) for the least weight m of a direction; what E(m) / N leaves is spread over the zeros."""
    dense = dense.select("dir", "t", "b", "f")
    x = F.log("r")
    line = _spread_counts(dense).groupBy("dir").agg(F.regr_slope(F.log("z"), x).alias("e"), F.regr_intercept(F.log("z"), x).alias("a"))
    sums = dense.groupBy("dir").agg(F.sum("f").alias("n"), F.min(F.when(F.col("f") > 0, F.col("f"))).alias("m"), F.count_if(F.col("f") == 0).alias("zeros"))
    met = dense.join(F.broadcast(line.join(sums, "dir")), "dir")
    up = (F.col("f") + F.col("m")) * F.pow((F.col("f") + F.col("m")) / F.col("f"), F.col("e"))
    zero = F.exp(F.col("a") + F.col("e") * F.log("m")) / F.col("n") / F.col("zeros")
    return met.select("dir", "t", "b", F.when(F.col("f") > 0, up).otherwise(zero).alias("value"))


def interpolated_profile(dense: DataFrame, over: str = "b", weights: DataFrame | None = None) -> DataFrame:
    """l2 f + l1 f(over), for a profile with ft, fb and n; ``over`` is the bound (b) or the target (t).

    Each pair's weight goes to the better of two leave-one-out estimates, in
    each direction.  With ``weights`` (l1, l2), such as those of all bigrams, both directions have these.
    """
    given, other = ("fb", "ft") if over == "b" else ("ft", "fb")
    if weights is not None:
        met = dense.crossJoin(F.broadcast(weights.select("l1", "l2")))  # one row
        return met.select("dir", "t", "b", (F.col("l2") * F.col("f") + F.col("l1") * F.col(given)).alias("value"))
    conditional = F.when(F.col(given) > 1, (F.col("f") - 1) / (F.col(given) - 1)).otherwise(0.0)
    plain = F.when(F.col("n") > 1, (F.col(other) - 1) / (F.col("n") - 1)).otherwise(0.0)
    won = dense.where("f > 0").groupBy("dir").agg(F.sum(F.when(conditional > plain, F.col("f")).otherwise(0.0)).alias("w2"), F.sum("f").alias("all"))
    met = dense.join(F.broadcast(won), "dir")
    share = F.col("w2") / F.col("all")
    return met.select("dir", "t", "b", (share * F.col("f") + (1 - share) * F.col(given)).alias("value"))


def frequency_entropy(dense: DataFrame) -> DataFrame:
    """-log2 of the share that a line fitted to log z over log(f + 1) gives to a weight f, among the different weights."""
    z = _spread_counts(dense)
    line = z.groupBy("dir").agg(F.regr_slope(F.log("z"), F.log(F.col("r") + 1)).alias("e"), F.regr_intercept(F.log("z"), F.log(F.col("r") + 1)).alias("a"))
    whole = z.join(line, "dir").groupBy("dir", "a", "e").agg(F.sum(F.exp(F.col("a") + F.col("e") * F.log(F.col("r") + 1))).alias("s"))
    met = dense.join(F.broadcast(whole), "dir")
    return met.select("dir", "t", "b", (F.log2("s") - (F.col("a") + F.col("e") * F.log(F.col("f") + 1)) / F.log(F.lit(2.0))).alias("value"))


def zipf_fitted(pairs: DataFrame, bigrams: DataFrame) -> DataFrame:
    """ln of the frequency that a line fitted to ln(f + 1) over the log of mean ranks gives to each bigram's rank."""
    order = Window.orderBy(F.desc("f"))  # one row for each different frequency
    levels = bigrams.groupBy("f").agg(F.count("*").alias("many")).select("f", (F.sum("many").over(order) - F.col("many") + (F.col("many") + 1) / 2).alias("rank"))
    line = levels.agg(F.regr_slope(F.log(F.col("f") + 1), F.log("rank")).alias("e"), F.regr_intercept(F.log(F.col("f") + 1), F.log("rank")).alias("a"))
    return pairs.join(levels, "f").crossJoin(F.broadcast(line)).select("dir", "t", "b", (F.col("a") + F.col("e") * F.log("rank")).alias("value"))


def cell_ranks(dense: DataFrame, shared: bool = True, joint: bool = False) -> DataFrame:
    """Ranks, from 0, of the cells by rising weight: mean ranks of equal weights, or, not ``shared``, one rank each in the order of the cells; in each direction, or over both (``joint``)."""
    if not shared:
        order = ["f", "dir", "t", "b"] if joint else ["dir", "f", "t", "b"]
        placed = indexed(dense.select("dir", "t", "b", "f"), order, "place")
        if joint:
            return placed.select("dir", "t", "b", F.col("place").cast("double").alias("value"))
        first = placed.groupBy("dir").agg(F.min("place").alias("first"))
        return placed.join(F.broadcast(first), "dir").select("dir", "t", "b", (F.col("place") - F.col("first")).cast("double").alias("value"))
    by = [] if joint else ["dir"]
    counts = dense.groupBy(*by, "f").agg(F.count("*").alias("many"))
    order = Window.partitionBy(*by).orderBy("f")  # one row for each different weight
    levels = counts.select(*by, "f", (F.sum("many").over(order) - F.col("many") + (F.col("many") - 1) / 2).alias("value"))
    return dense.join(levels, [*by, "f"]).select("dir", "t", "b", "value")


def weighted_sides(pairs: DataFrame) -> DataFrame:
    """p(t, b) of each direction times the direction's share of the target's summed mutual information."""
    row, column = Window.partitionBy("dir", "t"), Window.partitionBy("dir", "b")
    f = F.col("f")
    seen = pairs.withColumns({"rt": F.sum("f").over(row), "cb": F.sum("f").over(column)}).join(F.broadcast(pairs.groupBy("dir").agg(F.sum("f").alias("nl"))), "dir")
    mi = seen.groupBy("dir", "t").agg(F.sum(F.log2(f * F.col("nl") / (F.col("rt") * F.col("cb")))).alias("mi"))
    share = mi.withColumn("w", F.when(F.col("mi") != 0, F.col("mi") / F.sum("mi").over(Window.partitionBy("t"))).otherwise(0.0)).select("dir", "t", "w")
    return seen.join(share, ["dir", "t"]).select("dir", "t", "b", (f / F.col("nl") * F.col("w")).alias("value"))


def trigram_slots(pairs: DataFrame, trigrams: DataFrame, wide: bool = False) -> DataFrame:
    """(slot, w1, w2, w3, b, f): what stands right of w1 (0), left and right of w2 (1, 2) and left of w3 (3).

    Trigrams of a number that the caller sets are broadcast, with ``wide`` any number is joined.
    """
    names = ["w1", "w2", "w3"]
    out = None
    for slot, (word, side) in enumerate((("w1", "right"), ("w2", "left"), ("w2", "right"), ("w3", "left"))):
        some = trigrams.select(*names, F.col(word).alias("t"))
        part = (some if wide else F.broadcast(some)).join(pairs.where(F.col("dir") == side), "t").select(F.lit(slot).alias("slot"), *names, "b", "f")
        out = part if out is None else out.unionByName(part)
    return out


def global_frequency_entropy(dense: DataFrame, bigrams: DataFrame) -> DataFrame:
    """-log2 of a (f + 1)^e / N, for a line (ln a, e) fitted to log z over log(r + 1) of all bigrams; ``dense`` has n."""
    z = _spread_counts(bigrams.select(F.lit("all").alias("dir"), F.col("f").cast("double").alias("f")))
    line = z.agg(F.regr_slope(F.log("z"), F.log(F.col("r") + 1)).alias("e"), F.regr_intercept(F.log("z"), F.log(F.col("r") + 1)).alias("a"))
    met = dense.crossJoin(F.broadcast(line))
    return met.select("dir", "t", "b", (-(F.col("a") + F.col("e") * F.log(F.col("f") + 1)) / F.log(F.lit(2.0)) + F.log2("n")).alias("value"))


def frequency_entropy_with_pointers(dense: DataFrame) -> DataFrame:
    """``frequency_entropy``, and where it is above 0 half the bits of a pointer from target and bound to their partners."""
    found = frequency_entropy(dense).join(dense.select("dir", "t", "b", "ft", "fb", "nzt", "nzb"), ["dir", "t", "b"])
    pointers = -(F.log2(F.col("nzt") / F.col("ft")) + F.log2(F.col("nzb") / F.col("fb"))) / 2
    return found.select("dir", "t", "b", (F.col("value") + F.when(F.col("value") > 0, pointers).otherwise(0.0)).alias("value"))


def over_totals(profiled: DataFrame, total: str) -> DataFrame:
    """A profile's weights over the count of the target (``ft``) or of the bound (``fb``) in the whole corpus."""
    return profiled.select("dir", "t", "b", F.coalesce(F.col("f") / F.when(F.col(total) != 0, F.col(total)), F.lit(0.0)).alias("value"))


def remapped_partners(partners: DataFrame, membership: DataFrame) -> DataFrame:
    """(c, k): expected numbers of partners (w, k) when words are replaced by their classes (w, c, p)."""
    return partners.join(membership, "w").groupBy("c").agg(F.sum(F.col("p") * F.col("k")).alias("k"))
