"""Soft memberships of words in classes, and the hidden Markov models made of them.

A membership table has a row (w, c, p) for each word and each class that it may
belong to; what has no row has no share.  The p of a word add up to 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import EDGE


def of_shares(weighted: DataFrame, weight: Column | str = "p") -> DataFrame:
    """(w, c, p): weights over their sum for each word; words whose weights add up to 0 have no row."""
    x = weighted.select("w", "c", (F.col(weight) if isinstance(weight, str) else weight).alias("x")).where("x is not null")
    whole = x.groupBy("w").agg(F.sum("x").alias("whole")).where("whole <> 0")
    return x.join(whole, "w").select("w", "c", (F.col("x") / F.col("whole")).alias("p"))


def masked(membership: DataFrame, best: int) -> DataFrame:
    """The ``best`` likeliest classes of each word, ties to the smaller class, not renormalised."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("less"), "c")))  # as many as classes at most
    few = membership.groupBy("w").agg(F.slice(ordered, 1, best).alias("few"))
    return few.select("w", F.explode("few").alias("x")).select("w", "x.c", (-F.col("x.less")).alias("p"))


def n_best(membership: DataFrame, best: int) -> DataFrame:
    return of_shares(masked(membership, best))


def likeliest(membership: DataFrame) -> DataFrame:
    """(w, c): each word's likeliest class, ties to the smallest."""
    return membership.groupBy("w").agg(F.min(F.struct((-F.col("p")).alias("less"), "c")).alias("m")).select("w", "m.c")


def overwritten(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (w, …) of ``new``, and those of ``old`` whose word ``new`` does not have: how a stage's memberships, classes or distances are merged with earlier ones."""
    return old.join(new.select("w").distinct(), "w", "left_anti").unionByName(new)


def pooled(models: list[tuple[DataFrame, float]]) -> DataFrame:
    """(w, c, p): the memberships of several models, each with a weight, summed and renormalised."""
    out = None
    for membership, weight in models:
        one = membership.select("w", "c", (F.col("p") * weight).alias("p"))
        out = one if out is None else out.unionByName(one)
    return of_shares(out.groupBy("w", "c").agg(F.sum("p").alias("p")))


BONUSES = {
    "none": "p",
    "power": "pow(p, n)",
    "power_over_beta": "pow(p, n / beta)",
    "power_over_beta_plus": "pow(p, n * (1 / beta + more))",
    "power_over_frequency": "pow(p, n / f)",
}
"""What a membership p becomes before it is renormalised; beta and f are those of the word, n and more the caller's."""


def emissions(membership: DataFrame, unigrams: DataFrame, mode: str = "invert", bonus: str = "none", n: float = 1.0, more: float = 0.0, own: DataFrame | None = None, beta: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """(c, w, f): how often a class emits a word.

    ``invert`` gives p(c | w) f(w), ``sim`` the memberships themselves.
    Before that a ``bonus`` sharpens them, and ``n`` is added to a word's own
    class where ``own`` (w, c) is given instead of a bonus; ``beta`` (w, beta) belongs to two of the
    bonuses.  Then all but the ``best`` classes of a word, as ``membership`` orders them, are left out, and what
    is left is renormalised (in mode ``sim`` it isn't).  Words without a count emit nothing.
    """
    counts = unigrams.select("w", F.col("f").cast("double").alias("f"))
    sharp = membership.select("w", "c", "p")
    if own is not None:
        extra = own.select("w", "c", F.lit(float(n)).alias("p")).join(membership.select("w").distinct(), "w", "left_semi")
        sharp = of_shares(sharp.unionByName(extra).groupBy("w", "c").agg(F.sum("p").alias("p")))
    elif bonus != "none":
        met = sharp.join(counts, "w")
        if "beta" in BONUSES[bonus]:
            met = met.join(beta.select("w", "beta"), "w")
        sharp = of_shares(met.withColumns({"n": F.lit(float(n)), "more": F.lit(float(more))}), F.expr(BONUSES[bonus]))
    if best is not None:
        few = sharp.join(masked(membership, best).select("w", "c"), ["w", "c"])
        sharp = few if mode == "sim" else of_shares(few)
    if mode == "sim":
        return sharp.join(counts.select("w"), "w").select("c", "w", F.col("p").alias("f"))
    return sharp.join(counts, "w").select("c", "w", (F.col("p") * F.col("f")).alias("f"))


def expected_bigrams(membership: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(c1, c2, f): sum of p(c1 | w1) f(w1, w2) p(c2 | w2); the edge mark is a class of its own."""
    edge = membership.sparkSession.createDataFrame([(EDGE, EDGE, 1.0)], "w string, c string, p double")
    known = membership.select("w", F.col("c").cast("string").alias("c"), F.col("p").cast("double").alias("p")).unionByName(edge)
    # One side at a time, so that what the second join meets is counted by class already.
    first = bigrams.join(known.select(F.col("w").alias("w1"), F.col("c").alias("c1"), "p"), "w1").groupBy("c1", "w2").agg(F.sum(F.col("p") * F.col("f")).alias("f"))
    both = first.join(known.select(F.col("w").alias("w2"), F.col("c").alias("c2"), "p"), "w2")
    return both.groupBy("c1", "c2").agg(F.sum(F.col("p") * F.col("f")).alias("f")).where(f"c1 <> '{EDGE}' or c2 <> '{EDGE}'")


def transitions(membership: DataFrame, bigrams: DataFrame, mode: str = "estimate", best: int | None = None, own: DataFrame | None = None, emitted: DataFrame | None = None) -> DataFrame:
    """(c1, c2, f): how often class c2 follows c1; rows from the edge mark are starts, those to it ends.

    ``estimate``    expected counts under the ``best`` classes of each word, renormalised
    ``estimate1``   counts under one class of each word: ``own`` (w, c), or the likeliest
    ``estimateb``   a class is entered as often as it emits, ``emitted`` (c, w, f), over the number of classes and one; each ends once
    ``uniform``     every class follows every one, starts and ends once
    """
    if mode == "estimate":
        return expected_bigrams(n_best(membership, best) if best else membership, bigrams)
    if mode == "estimate1":
        hard = own.select("w", "c") if own is not None else likeliest(membership)
        return expected_bigrams(hard.withColumn("p", F.lit(1.0)), bigrams)
    name = F.col("c").cast("string")
    if mode == "uniform":
        into = membership.select(name.alias("c2")).distinct().withColumn("f", F.lit(1.0))
    elif mode == "estimateb":
        mass = emitted.groupBy(name.alias("c2")).agg(F.sum("f").alias("f"))
        into = mass.crossJoin(F.broadcast(mass.agg(F.count("*").alias("k")))).select("c2", (F.col("f") / (F.col("k") + 1)).alias("f"))
    else:
        raise ValueError(f"no mode of transitions: {mode}")
    # A row for each two classes: the matrix that a hidden Markov model has anyway.
    sources = into.select(F.col("c2").alias("c1"))
    edge = into.sparkSession.createDataFrame([(EDGE,)], "c1 string")
    ends = sources.select("c1", F.lit(EDGE).alias("c2"), F.lit(1.0).alias("f"))
    return sources.unionByName(edge).crossJoin(F.broadcast(into)).select("c1", "c2", "f").unionByName(ends)


def unknown_by_types(own: DataFrame, share: float) -> DataFrame:
    """(c, p): ``share`` of an unknown word's mass, dealt to the classes by how many words (w, c) each holds."""
    sizes = own.groupBy("c").agg(F.count("*").alias("n"))
    return sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("whole")))).select("c", (F.lit(float(share)) * F.col("n") / F.col("whole")).alias("p"))


def restricted(emitted: DataFrame, q: int, least: float = 0.0) -> DataFrame:
    """(c, w, f): of each word the ``q`` largest emissions above ``least``, ties to the smaller class."""
    few = emitted.where(F.col("f") > least).groupBy("w").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("f")).alias("less"), "c"))), 1, q).alias("few"))
    return few.select("w", F.explode("few").alias("x")).select("x.c", "w", (-F.col("x.less")).alias("f"))


def labels(emitted: DataFrame, own: DataFrame) -> DataFrame:
    """(c, label): a class's name and the two of its own words (w, c) that it emits most, ties to the smaller word."""
    met = emitted.join(own.select("w", "c"), ["w", "c"]).select("c", F.struct((-F.col("f")).alias("less"), "w").alias("m"))
    first = met.groupBy("c").agg(F.min("m").alias("first"))  # two partial aggregates: a class may hold most words
    second = met.join(first, "c").where(F.col("m") != F.col("first")).groupBy("c").agg(F.min("m").alias("second"))
    return first.join(second, "c", "left").select("c", F.concat_ws("_", F.col("c").cast("string"), "first.w", "second.w").alias("label"))
