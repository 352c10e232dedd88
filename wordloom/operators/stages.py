"""Staged induction of word classes: memberships, class models and their description lengths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import kept
from .corpus import EDGE
from .distribution import normalized


def emissions(membership: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(c, w, f): p(c | w) f(w)."""
    return membership.join(unigrams, "w").select("c", "w", (F.col("p") * F.col("f")).alias("f"))


def transitions(membership: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(c1, c2, f): expected class bigrams, sum p(c1 | w1) f p(c2 | w2); the edge mark is a class of its own."""
    edge = membership.sparkSession.createDataFrame([(EDGE, EDGE, 1.0)], "w string, c string, p double")
    known = membership.select("w", F.col("c").cast("string").alias("c"), F.col("p").cast("double").alias("p")).unionByName(edge)
    first = bigrams.join(known.select(F.col("w").alias("w1"), F.col("c").alias("c1"), F.col("p").alias("p1")), "w1")
    both = first.join(known.select(F.col("w").alias("w2"), F.col("c").alias("c2"), F.col("p").alias("p2")), "w2")
    return both.groupBy("c1", "c2").agg(F.sum(F.col("p1") * F.col("f") * F.col("p2")).alias("f"))


def class_labels(members: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(c, label): a class's number and its two most frequent members."""
    place = F.struct((-F.col("f")).alias("f"), "w")
    met = kept(members.join(unigrams, "w").select("c", place.alias("m")), "members")
    first = met.groupBy("c").agg(F.min("m").alias("first"))  # two partial aggregates: a class may hold most words
    second = met.join(first, "c").where(F.col("m") != F.col("first")).groupBy("c").agg(F.min("m").alias("second"))
    return first.join(second, "c", "left").select("c", F.concat_ws("_", F.col("c").cast("string"), "first.w", "second.w").alias("label"))


def description_length(members: DataFrame, unigrams: DataFrame, class_bigrams: DataFrame) -> DataFrame:
    """(model, corpus): bits to name each word's class, and to code the corpus by class transitions and emissions."""
    k = members.agg((F.count("*") * F.log2(F.count_distinct("c").cast("double"))).alias("model"))
    moves = normalized(class_bigrams, "c1").agg((-F.sum(F.col("f") * F.log2("p"))).alias("a"))
    words = normalized(members.join(unigrams, "w").select("c", "w", "f"), "c").agg((-F.sum(F.col("f") * F.log2("p"))).alias("b"))
    return k.crossJoin(moves).crossJoin(words).select("model", (F.col("a") + F.col("b")).alias("corpus"))


def merged_classes(counts: np.ndarray, k: int) -> list[int]:
    """Classes of a small vocabulary, merged two at a time so that the mutual information of class bigrams falls least; ties to the lowest pair."""
    label = list(range(len(counts)))
    c = counts.astype(float)

    def information(m: np.ndarray) -> float:
        n, r, s = m.sum(), m.sum(axis=1, keepdims=True), m.sum(axis=0, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            return float(np.nansum(np.where(m > 0, m / n * np.log2(m * n / (r * s)), 0)))

    while len(c) > k:
        best = None
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                m = c.copy()
                m[i] += m[j]
                m[:, i] += m[:, j]
                v = information(np.delete(np.delete(m, j, 0), j, 1))
                if best is None or v > best[0] + 1e-12:
                    best = (v, i, j)
        _, i, j = best
        c[i] += c[j]
        c[:, i] += c[:, j]
        c = np.delete(np.delete(c, j, 0), j, 1)
        label = [i if x == j else x - (x > j) for x in label]
    return label


def singular_vectors(points: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the k largest singular values of the rows (v); only sums of products, d by d, are gathered."""
    d = points.select(F.size("v")).first()[0]

    def products(frames):
        total = np.zeros((d, d))
        for frame in frames:
            x = np.array(frame["v"].tolist(), float)
            total += x.T @ x
        import pandas as pd

        yield pd.DataFrame({"g": [total.ravel().tolist()]})

    rows = points.select("v").mapInPandas(products, "g array<double>").select(F.posexplode("g").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros(d * d)
    for r in rows:
        gram[r["at"]] = r["x"]
    values, vectors = np.linalg.eigh(gram.reshape(d, d))
    order = np.argsort(-values)[:k]
    vectors = vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1, 1)
    return np.sqrt(np.maximum(values[order], 0)), vectors


def projected(points: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(id, u): rows (id, v) in the space of the singular vectors."""
    parts = [F.aggregate(F.zip_with("v", F.lit(list(map(float, vectors[:, j]))), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for j in range(vectors.shape[1])]
    return points.select("id", F.array(*parts).alias("u"))
