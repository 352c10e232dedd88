"""Lexica of (word, tag) counts, and how well one labelling predicts another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import kept
from .distribution import entropy, marginal


def lexicon(tagged: DataFrame) -> DataFrame:
    """(w, tag, f) with totals: rows without a tag count the word, the row without either counts all."""
    return tagged.rollup("w", "tag").agg(F.count("*").alias("f"))


def best_tags(lex: DataFrame) -> DataFrame:
    """(w, tag): each word's most frequent tag, ties to the smallest."""
    return lex.groupBy("w").agg(F.min(F.struct((-F.col("f")).alias("f"), "tag")).alias("m")).select("w", F.col("m.tag").alias("tag"))


def lexicon_accuracy(tagged: DataFrame, best: DataFrame) -> DataFrame:
    """(tokens, unknown, right): of tagged tokens against each word's best tag."""
    met = tagged.join(best.select("w", F.col("tag").alias("_best")), "w", "left")
    return met.agg(F.count("*").alias("tokens"), F.count_if(F.col("_best").isNull()).alias("unknown"), F.count_if(F.col("_best") == F.col("tag")).alias("right"))


def information(lex: DataFrame) -> DataFrame:
    """(h_joint, h_w, h_tag, mi, h_tag_given_w, h_w_given_tag) of (w, tag, f)."""
    joint, words, tags = entropy(lex), entropy(marginal(lex, "w")), entropy(marginal(lex, "tag"))
    all_of = joint.select(F.col("h").alias("h_joint")).crossJoin(words.select(F.col("h").alias("h_w"))).crossJoin(tags.select(F.col("h").alias("h_tag")))
    return all_of.select("h_joint", "h_w", "h_tag", (F.col("h_w") + F.col("h_tag") - F.col("h_joint")).alias("mi"), (F.col("h_joint") - F.col("h_w")).alias("h_tag_given_w"), (F.col("h_joint") - F.col("h_tag")).alias("h_w_given_tag"))


def expected_agreement(lex: DataFrame) -> DataFrame:
    """(precision, recall): the sums of f^2 / (N f(w)) and f^2 / (N f(tag))."""
    lex = kept(lex, "lexicon")
    n = F.broadcast(lex.agg(F.sum("f").alias("n")))
    of_w, of_tag = (marginal(lex, c).withColumnRenamed("f", f"f_{c}") for c in ("w", "tag"))
    seen = lex.join(of_w, "w").join(of_tag, "tag").crossJoin(n)
    square = F.col("f").cast("double") * F.col("f") / F.col("n")
    return seen.agg(F.sum(square / F.col("f_w")).alias("precision"), F.sum(square / F.col("f_tag")).alias("recall"))


def induced_tags(lex: DataFrame) -> DataFrame:
    """(precision, recall, mutual) of induced tags w against wanted ones: the shares of tokens in each w's best tag, in each tag's best w, and in both."""
    n = F.broadcast(lex.agg(F.sum("f").alias("n")))
    best = lex.groupBy("w").agg(F.min(F.struct((-F.col("f")).alias("f"), "tag")).alias("m")).select("w", F.col("m.tag").alias("best_tag"))
    back = lex.groupBy("tag").agg(F.min(F.struct((-F.col("f")).alias("f"), "w")).alias("m")).select("tag", F.col("m.w").alias("best_w"))
    met = lex.join(best, "w").join(back, "tag").crossJoin(n)
    share = lambda c: F.sum(F.when(c, F.col("f")).otherwise(0)) / F.max("n")
    there, here = F.col("tag") == F.col("best_tag"), F.col("w") == F.col("best_w")
    return met.agg(share(there).alias("precision"), share(here).alias("recall"), share(there & here).alias("mutual"))


def boundary_scores(pairs: DataFrame, found: str, wanted: str) -> DataFrame:
    """(right, found, wanted, precision, recall, f1): over arrays of boundary places, one row a word."""
    sums = pairs.agg(F.sum(F.size(F.array_intersect(found, wanted))).alias("right"), F.sum(F.size(found)).alias("found"), F.sum(F.size(wanted)).alias("wanted"))
    p, r = F.col("right") / F.col("found"), F.col("right") / F.col("wanted")
    return sums.select("right", "found", "wanted", p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1"))


def boundary_places(parse: Column | str, separator: str = ".") -> Column:
    """The places, in letters, at which a parse is cut; null for no parse."""
    parts = F.split(parse, f"[{separator}]")
    sizes = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.length(x))
    return F.aggregate(sizes, F.array().cast("array<int>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x)))


def segmentation_report(words: DataFrame, separator: str = ".") -> DataFrame:
    """(unit, n, coverage1, coverage2, right, found, wanted, precision, recall, f1) of (w, seg1, seg2, f), a row for each word and pair of its parses with their count.

    ``unit`` is token, where each counts ``f`` times, or type, where a word counts
    once, by the least of its parses.  A null parse is unknown: it lowers the
    coverage, and the word's boundaries are not compared.
    """
    types = words.groupBy("w").agg(F.min(F.struct("seg1", "seg2")).alias("s")).select(F.lit("type").alias("unit"), "s.seg1", "s.seg2", F.lit(1).cast("long").alias("f"))
    rows = words.select(F.lit("token").alias("unit"), "seg1", "seg2", F.col("f").cast("long").alias("f")).unionByName(types)
    both = F.col("seg1").isNotNull() & F.col("seg2").isNotNull()
    placed = rows.select("unit", "f", "seg1", "seg2", boundary_places("seg1", separator).alias("a"), boundary_places("seg2", separator).alias("b"))
    count = lambda size: F.sum(F.when(both, size * F.col("f")).otherwise(0))
    known = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("f")).otherwise(0)) / F.sum("f")
    sums = placed.groupBy("unit").agg(F.sum("f").alias("n"), known("seg1").alias("coverage1"), known("seg2").alias("coverage2"), count(F.size(F.array_intersect("a", "b"))).alias("right"), count(F.size("a")).alias("found"), count(F.size("b")).alias("wanted"))
    p, r = F.try_divide("right", "found"), F.try_divide("right", "wanted")
    return sums.select("*", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))
