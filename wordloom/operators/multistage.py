"""Word classes found in stages of falling frequency, with soft memberships.

A first stage clusters the most frequent words by the words around them.  Each
later one brings new words, and the words around these are replaced by the
classes that they belong to, each with its share (edge marks stay as they are).
The kinds differ in what is clustered then:

``attach``     new words are attached to the nearest of the old classes
``full``       all words so far are clustered afresh
``parallel``   new words alone are clustered, into classes of their own beside the old ones
``deep``       new words are clustered together with the old classes, each of which stands for its words

The last stage takes all words that are left.  A model is a table of each word's
own class with its stage, and the distances of words to classes, from which
``beta`` makes memberships: the larger it is, the harder they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import kept
from . import sparse_rows
from .corpus import EDGE
from .soft_classes import of_shares, overwritten

BROADCAST = 20_000
"""Most words with shares that are broadcast; more are joined by a shuffle."""
KINDS = ("attach", "full", "parallel", "deep")


@dataclass
class Model:
    """``own`` (w, c, stage), and ``far`` (w, c, d) of each word's nearest classes."""

    own: DataFrame
    far: DataFrame

    def membership(self, beta: float = 1.0, betas: DataFrame | None = None, base: float = 2.0) -> DataFrame:
        """(w, c, p): base^(-beta d) over their sum; ``betas`` (w, beta) gives each word its own.

        Distances count from a word's least, so that no beta makes all its weights vanish.
        """
        far = self.far.join(self.far.groupBy("w").agg(F.min("d").alias("least")), "w")
        far = far if betas is None else far.join(betas, "w")
        b = F.lit(float(beta)) if betas is None else F.col("beta") * float(beta)
        return of_shares(far, F.pow(F.lit(base), -b * (F.col("d") - F.col("least"))))


def frequency_betas(unigrams: DataFrame) -> DataFrame:
    """(w, beta): a word's count over the mean count, so that the classes of frequent words are the surest."""
    counts = unigrams.select("w", F.col("f").cast("double").alias("f"))
    return counts.crossJoin(F.broadcast(counts.agg(F.avg("f").alias("mean")))).select("w", (F.col("f") / F.col("mean")).alias("beta"))


def cells(bigrams: DataFrame, targets: DataFrame) -> DataFrame:
    """(dir, t, b, f): what stands before (``left``) and after (``right``) each target, over all words."""
    t = targets.select(F.col("w").alias("t"))
    left = bigrams.select(F.col("w2").alias("t"), F.col("w1").alias("b"), "f").join(t, "t").select(F.lit("left").alias("dir"), "t", "b", "f")
    return left.unionByName(bigrams.select(F.col("w1").alias("t"), F.col("w2").alias("b"), "f").join(t, "t").select(F.lit("right").alias("dir"), "t", "b", "f"))


def over_classes(pairs: DataFrame, membership: DataFrame, literal: DataFrame | None = None) -> DataFrame:
    """(dir, t, b, f): bounds replaced by ``~<class>`` with expected counts p(c | b) f; the edge mark and ``literal`` (w) bounds stay, unknown ones go."""
    stay = pairs.sparkSession.createDataFrame([(EDGE,)], "w string")
    stay = stay if literal is None else stay.unionByName(literal.select("w")).distinct()
    soft = membership.join(stay, "w", "left_anti").select(F.col("w").alias("b"), F.concat(F.lit("~"), F.col("c").cast("string")).alias("to"), "p")
    known = soft.unionByName(stay.select(F.col("w").alias("b"), F.col("w").alias("to"), F.lit(1.0).alias("p")))
    return pairs.join(known, "b").groupBy("dir", "t", F.col("to").alias("b")).agg(F.sum(F.col("f") * F.col("p")).alias("f"))


def class_counts(bigrams: DataFrame, targets: DataFrame, membership: DataFrame) -> DataFrame:
    """What ``over_classes(cells(bigrams, targets), membership)`` gives, counted in one pass over the bigrams.

    A neighbour's shares are one array, and neighbours without a class go before
    anything is grouped, so a bigram gives a row a side at most, and the targets
    are joined with sums.
    """
    classes = [r["c"] for r in membership.select("c").distinct().orderBy("c").collect()]  # a row for each class
    if not classes:
        return over_classes(cells(bigrams, targets), membership)
    shares = membership.where(F.col("w") != EDGE).groupBy(F.col("w").alias("b")).agg(*[F.coalesce(F.sum(F.when(F.col("c") == c, F.col("p"))), F.lit(0.0)).alias(f"p{i}") for i, c in enumerate(classes)])
    edge = bigrams.sparkSession.createDataFrame([(EDGE,)], "b string").select("b", *[F.lit(0.0).alias(f"p{i}") for i in range(len(classes))])
    known = kept(shares.unionByName(edge), "shares")
    known = F.broadcast(known) if known.limit(BROADCAST + 1).count() <= BROADCAST else known
    sides = bigrams.select(F.explode(F.array(F.struct(F.lit("left").alias("dir"), F.col("w2").alias("t"), F.col("w1").alias("b")), F.struct(F.lit("right").alias("dir"), F.col("w1").alias("t"), F.col("w2").alias("b")))).alias("x"), "f")
    met = sides.select("x.*", "f").where(F.col("t") != EDGE).join(known, "b")
    sums = [F.sum(F.col("f") * F.col(f"p{i}")).alias(f"p{i}") for i in range(len(classes))]
    of_edge = F.sum(F.when(F.col("b") == EDGE, F.col("f").cast("double"))).alias("edge")
    counts = met.groupBy("dir", "t").agg(*sums, of_edge).join(targets.select(F.col("w").alias("t")), "t")
    each = F.array(F.struct(F.lit(EDGE).alias("b"), F.col("edge").alias("f")), *[F.struct(F.lit(f"~{c}").alias("b"), F.when(F.col(f"p{i}") != 0, F.col(f"p{i}")).alias("f")) for i, c in enumerate(classes)])
    return counts.select("dir", "t", F.explode(each).alias("x")).select("dir", "t", "x.*").where("f is not null")


def slots_over_classes(slots: DataFrame, membership: DataFrame, hard: bool) -> DataFrame:
    """The trigram slots (slot, w1, w2, w3, b, f) with bounds replaced by their likeliest class (``hard``) or by all with expected counts; edge marks stay, unknown bounds go."""
    from .soft_classes import likeliest

    soft = likeliest(membership).withColumn("p", F.lit(1.0)) if hard else membership
    edge = slots.sparkSession.createDataFrame([(EDGE, EDGE, 1.0)], "b string, to string, p double")
    known = soft.where(F.col("w") != EDGE).select(F.col("w").alias("b"), F.concat(F.lit("~"), F.col("c").cast("string")).alias("to"), "p").unionByName(edge)
    return slots.join(known, "b").groupBy("slot", "w1", "w2", "w3", F.col("to").alias("b")).agg(F.sum(F.col("f") * F.col("p")).alias("f"))


def with_pseudo_targets(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(dir, t, b, f): the counts of words that have a class (w, c) are added to those of the pseudo-target ``~<class>``; others stay."""
    named = own.select(F.col("w").alias("t"), F.concat(F.lit("~"), F.col("c").cast("string")).alias("to"))
    return pairs.join(named, "t", "left").groupBy("dir", F.coalesce("to", "t").alias("t"), "b").agg(F.sum("f").alias("f"))


def _first(bigrams: DataFrame, unigrams: DataFrame, targets: DataFrame, n_bounds: int, k: int, rounds: int, how: str) -> tuple[Model, DataFrame]:
    bounds = unigrams.orderBy(F.desc("f"), "w").limit(n_bounds).select("w")
    edge = unigrams.sparkSession.createDataFrame([(EDGE,)], "w string")
    literal = F.broadcast(bounds.unionByName(edge).select(F.col("w").alias("b")))
    rows = kept(sparse_rows.shares(cells(bigrams, targets).join(literal, "b")), "rows")
    return _clustered(rows, unigrams, k, rounds, how, 1)


def _clustered(rows: DataFrame, weights: DataFrame, k: int, rounds: int, how: str, stage: int, first: int = 0, bonus: bool = False) -> tuple[Model, DataFrame]:
    """The model of rows clustered alone, and its centres; with ``bonus`` a word's distance to its own class is 0."""
    own, centres = sparse_rows.kmeans(rows, sparse_rows.started(rows, weights, k, first), rounds, how)
    return _model(rows, own, centres, how, stage, bonus), centres


def _model(rows: DataFrame, own: DataFrame, centres: DataFrame, how: str, stage: int, bonus: bool = False) -> Model:
    far = sparse_rows.distances(rows, centres, how)
    if bonus:
        far = far.join(own.select("t", F.col("c").alias("mine")), "t").select("t", "c", F.when(F.col("c") == F.col("mine"), 0.0).otherwise(F.col("d")).alias("d"))
    named = lambda df: df.withColumnRenamed("t", "w")
    return Model(kept(named(own.select("t", "c")).withColumn("stage", F.lit(stage)), "classes"), kept(named(far), "far"))


def next_stage(kind: str, model: Model, bigrams: DataFrame, unigrams: DataFrame, fresh: DataFrame, stage: int, k: int, rounds: int = 5, how: str = "l1", beta: float = 1.0, betas: DataFrame | None = None, bonus: bool = False) -> Model:
    """The model with the words ``fresh`` (w), which have no class yet."""
    membership = kept(model.membership(beta, betas), "membership")
    old = model.own.select("w", "c")
    targets = fresh.select("w") if kind == "parallel" else fresh.select("w").unionByName(old.select("w"))
    pairs = kept(class_counts(bigrams, targets, membership), "cells")
    if kind == "full":
        return _clustered(kept(sparse_rows.shares(pairs), "rows"), unigrams, k, rounds, how, stage, bonus=bonus)[0]
    if kind == "parallel":
        rows = kept(sparse_rows.shares(pairs), "rows")
        first = (old.agg(F.max("c")).first()[0] or 0) + 1
        new = _clustered(rows, unigrams, k, rounds, how, stage, first, bonus)[0]
    elif kind == "deep":
        mixed = kept(with_pseudo_targets(pairs, old), "mixed")
        rows = kept(sparse_rows.shares(mixed), "rows")
        weights = kept(mixed.groupBy(F.col("t").alias("w")).agg((F.sum("f") / 2).alias("f")), "weights")
        found, _ = _clustered(rows, weights, k, rounds, how, stage, bonus=bonus)
        # Old words go where their class goes.
        gone = found.own.select(F.col("w").alias("to"), "c")
        moved = model.own.select("w", "stage", F.concat(F.lit("~"), F.col("c").cast("string")).alias("to")).join(gone, "to").select("w", "c", "stage")
        is_class = F.startswith("w", F.lit("~"))
        far = model.own.select("w", F.concat(F.lit("~"), F.col("c").cast("string")).alias("to")).join(found.far.select(F.col("w").alias("to"), "c", "d"), "to").select("w", "c", "d")
        return Model(kept(moved.unionByName(found.own.where(~is_class)), "classes"), kept(far.unionByName(found.far.where(~is_class)), "far"))
    elif kind == "attach":
        rows = kept(sparse_rows.shares(with_pseudo_targets(pairs, old)), "rows")
        is_class = F.startswith("t", F.lit("~"))
        centres = kept(rows.where(is_class).select(F.expr("substring(t, 2)").cast("int").alias("c"), "k", "x"), "centres")
        others = kept(rows.where(~is_class), "fresh")
        new = _model(others, kept(sparse_rows.nearest(sparse_rows.distances(others, centres, how)), "attached"), centres, how, stage, bonus)
    else:
        raise ValueError(f"no kind of stages: {kind}")
    return Model(kept(overwritten(model.own, new.own), "classes"), kept(overwritten(model.far, new.far), "far"))


def staged(kind: str, bigrams: DataFrame, unigrams: DataFrame, sizes: list[int | None], n_bounds: int, k: int, rounds: int = 5, how: str = "l1", beta: float = 1.0, by_frequency: bool = False, bonus: bool = False) -> Model:
    """A model of the words in stages: the ``sizes[i]`` most frequent words are there after stage i, all of them where that is None.

    ``by_frequency`` multiplies beta with ``frequency_betas``; ``bonus`` sets
    each word's distance to its own class to 0.  Words whose neighbours are all
    unknown (they stand beside words of later stages only) have no class.
    """
    betas = kept(frequency_betas(unigrams), "betas") if by_frequency else None
    upto = lambda n: unigrams.select("w") if n is None else unigrams.orderBy(F.desc("f"), "w").limit(n).select("w")
    model, _ = _first(bigrams, unigrams, upto(sizes[0]), n_bounds, k, rounds, how)
    for stage, n in enumerate(sizes[1:], 2):
        fresh = kept(upto(n).join(model.own.select("w"), "w", "left_anti"), "fresh")
        model = next_stage(kind, model, bigrams, unigrams, fresh, stage, k, rounds, how, beta, betas, bonus)
    return model
