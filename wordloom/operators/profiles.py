"""Left and right co-occurrence profiles and their association measures.

A profile has a row for each direction, target t and bound b: ``left`` when the
bound stands before the target, ``right`` when it stands after it.  Measures are
SQL expressions over its columns:

    f              how often the pair occurs in this direction
    ftl, fbl, nl   sums of f over the target's row, the bound's column, the direction
    ft, fb, n      counts of target, bound and everything among all bigrams (as second words)
    nzt, nzb, nz   different partners of target and bound in all bigrams by position, and of all
    nt, nb         how many targets and bounds there are

Sparse measures are 0 where f is; dense ones are computed for every pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LIKELIHOOD = "(CASE WHEN {k} = 0 THEN 0 ELSE {k} * ln({p}) END + CASE WHEN {m} - {k} = 0 THEN 0 ELSE ({m} - {k}) * ln(1 - {p}) END)"


def _log_likelihood(k: str, m: str, p: str) -> str:
    return _LIKELIHOOD.format(k=k, m=m, p=p)


_RATIO = "-2 * ({} + {} - {} - {})".format(
    _log_likelihood("f", "ftl", "(fbl / nl)"), _log_likelihood("(fbl - f)", "(nl - ftl)", "(fbl / nl)"),
    _log_likelihood("f", "ftl", "(f / ftl)"), _log_likelihood("(fbl - f)", "(nl - ftl)", "((fbl - f) / (nl - ftl))"),
)

SPARSE = {
    "conditional": "f / ftl",
    "raw": "f",
    "inverse": "f / fbl",
    "joint": "f / n",
    "mi": "log2(f * nl / (ftl * fbl))",
    "joint_mi": "f / nl * log2(f * nl / (ftl * fbl))",
    "conditional_mi": "f / ftl * log2(f * nl / (ftl * fbl))",
    "relative_pmi": "(log2(n / ft) + log2(n / fb) - log2(n / f)) / log2(n / f)",
    "entropy": "-(f / ftl) * log2(f / ftl)",
    "length": "-f * log2(f / ftl)",
    "length_global": "-f * log2(f / ft)",
    "inverse_length": "-f * log2(f / fbl)",
    "inverse_length_global": "-f * log2(f / fb)",
    "information_gain": "log2((f / ftl) / (fb / n))",
}

DENSE = {
    "smoothed_gain": "log2(((f + 1) / (1 + ft)) / (fb / n))",
    "binary_conditional": "2 * log2(n / (f + 1)) - log2(n / (ft + 1)) - log2(n / (fb + 1))",
    "hoeffding": "sign(f / ft - fb / n) * (2 - 2 * exp(-2 * ft * (f / ft - fb / n) * (f / ft - fb / n)))",
    "likelihood_ratio": f"CASE WHEN ftl = 0 OR fbl = 0 OR nl = ftl THEN 0 ELSE {_RATIO} END",
    "google_distance": "(greatest(ln(fb + 1), ln(ft + 1)) - ln(f + 1)) / (ln(n) - least(ln(fb + 1), ln(ft + 1)))",
    "log_frequency": "ln(f + 1)",
    "log_frequency_degrees": "log2(f + 1) + log2(nzb) / nt + log2(nzt) / nb",
    "log_frequency_half_degrees": "log2(f + 1) + 0.5 * log2(nzb) / nt + 0.5 * log2(nzt) / nb",
    "arc_size": "log2(f + 1) - log2(nzt / nz) - log2(nzb / nz)",
    "gamma_code": "2 * log2(f + 1) + 1",
}


def most_frequent(unigrams: DataFrame, n: int) -> DataFrame:
    """(w): the n most frequent words, ties in the order of the words."""
    return unigrams.orderBy(F.desc("f"), "w").limit(n).select("w")


def extracted(bigrams: DataFrame, targets: DataFrame, bounds: DataFrame) -> DataFrame:
    """(dir, t, b, f): the bigrams (w1, w2, f) of a target and a bound, in either order."""
    t, b = F.broadcast(targets.select(F.col("w").alias("t"))), F.broadcast(bounds.select(F.col("w").alias("b")))
    left = bigrams.select(F.col("w2").alias("t"), F.col("w1").alias("b"), "f").join(t, "t").join(b, "b").select(F.lit("left").alias("dir"), "t", "b", "f")
    right = bigrams.select(F.col("w1").alias("t"), F.col("w2").alias("b"), "f").join(t, "t").join(b, "b").select(F.lit("right").alias("dir"), "t", "b", "f")
    return left.unionByName(right)


def profile(bigrams: DataFrame, targets: DataFrame, bounds: DataFrame, dense: bool) -> DataFrame:
    """The profile with all columns that measures use; with ``dense`` all pairs of a target and a bound.

    Targets and bounds are dictionaries of a size that the caller sets, so the
    dense table has 2 |targets| |bounds| rows whatever the corpus.
    """
    pairs = extracted(bigrams, targets, bounds)
    if dense:
        sides = targets.sparkSession.createDataFrame([("left",), ("right",)], "dir string")
        grid = sides.crossJoin(targets.select(F.col("w").alias("t"))).crossJoin(F.broadcast(bounds.select(F.col("w").alias("b"))))
        pairs = grid.join(pairs, ["dir", "t", "b"], "left").withColumn("f", F.coalesce("f", F.lit(0)))
    marked = bigrams.where((F.col("w1").isNotNull()) & (F.col("w2").isNotNull()))
    second = marked.groupBy(F.col("w2").alias("w")).agg(F.sum("f").alias("f2"), F.count("*").alias("before"))
    first = marked.groupBy(F.col("w1").alias("w")).agg(F.count("*").alias("after"))
    words = targets.select("w").unionByName(bounds.select("w")).distinct()
    known = F.broadcast(words.join(second, "w", "left").join(first, "w", "left").select("w", F.coalesce("f2", F.lit(0)).alias("f2"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")))
    sizes = F.broadcast(marked.agg(F.sum("f").cast("double").alias("n"), F.count("*").cast("double").alias("nz")).crossJoin(targets.agg(F.count("*").cast("double").alias("nt"))).crossJoin(bounds.agg(F.count("*").cast("double").alias("nb"))))
    left = F.col("dir") == "left"
    out = pairs.withColumn("f", F.col("f").cast("double"))
    out = out.withColumns({"ftl": F.sum("f").over(Window.partitionBy("dir", "t")), "fbl": F.sum("f").over(Window.partitionBy("dir", "b"))})
    totals = F.broadcast(pairs.groupBy("dir").agg(F.sum("f").cast("double").alias("nl")))
    out = out.join(totals, "dir")
    of_t = known.select(F.col("w").alias("t"), F.col("f2").cast("double").alias("ft"), F.col("before").alias("tb"), F.col("after").alias("ta"))
    of_b = known.select(F.col("w").alias("b"), F.col("f2").cast("double").alias("fb"), F.col("before").alias("bb"), F.col("after").alias("ba"))
    out = out.join(of_t, "t").join(of_b, "b").crossJoin(sizes)
    return out.withColumns({"nzt": F.when(left, F.col("tb")).otherwise(F.col("ta")).cast("double"), "nzb": F.when(left, F.col("ba")).otherwise(F.col("bb")).cast("double")}).drop("tb", "ta", "bb", "ba")


def measured(profiled: DataFrame, name: str) -> DataFrame:
    """(dir, t, b, value) of a measure."""
    return profiled.select("dir", "t", "b", F.expr(SPARSE.get(name) or DENSE[name]).cast("double").alias("value"))


def normalized_rows(values: DataFrame, how: str) -> DataFrame:
    """A profile's values over (rows ``mass``, columns ``column_mass``) their sum, |sum| (``absolute``), largest |value| (``limit``), or stretched so that the extremes are 1 and -1 (``stretch``)."""
    row, column = Window.partitionBy("dir", "t"), Window.partitionBy("dir", "b")
    v = F.col("value")
    if how == "stretch":
        up, down = F.max(F.greatest(v, F.lit(0.0))).over(row), F.max(F.greatest(-v, F.lit(0.0))).over(row)
        out = F.when(v > 0, v / up).when(v < 0, v / down).otherwise(0.0)
    else:
        whole = {"mass": F.sum(v).over(row), "column_mass": F.sum(v).over(column), "absolute": F.sum(F.abs(v)).over(row), "limit": F.max(F.abs(v)).over(row)}[how]
        out = F.coalesce(v / F.when(whole != 0, whole), F.lit(0.0))
    return values.withColumn("value", out)


def remapped_bounds(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """(dir, t, b, f): expected counts when each bound b is replaced by its classes (b, c, p)."""
    return pairs.join(membership, "b").groupBy("dir", "t", F.col("c").alias("b")).agg(F.sum(F.col("f") * F.col("p")).alias("f"))


def remapped_targets(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """(dir, t, b, f): expected counts when each target t is replaced by its classes (t, c, p)."""
    return pairs.join(membership, "t").groupBy("dir", F.col("c").alias("t"), "b").agg(F.sum(F.col("f") * F.col("p")).alias("f"))


def inverted(membership: DataFrame, prior: DataFrame) -> DataFrame:
    """(c, b, p): p(b | c) from p(c | b) and the weights (b, f), by Bayes' rule."""
    joint = membership.join(prior, "b").withColumn("j", F.col("p") * F.col("f"))
    return joint.select("c", "b", (F.col("j") / F.sum("j").over(Window.partitionBy("c"))).alias("p"))


def strongest(values: DataFrame, n: int) -> DataFrame:
    """The n largest values of each direction and target."""
    order = Window.partitionBy("dir", "t").orderBy(F.desc("value"), "b")
    return values.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
