import random
import re
import statistics
import time
import unicodedata

import duckdb
import numpy as np
from pyspark.sql import functions as F

from wordloom.operators import clustering, collection, corpus, fitting
from wordloom.plans import shapes, text
from wordloom.plans.registry import QUERIES, SENTENCES

LINES = "Überdruß, the café's 12 naïve!\nΚαλημέρα κόσμε\n日本語 テキスト\n--- ***\nе\u0301лка x"
WANT = [["überdruß", "the", "café", "s", "12", "naïve"], ["καλημέρα", "κόσμε"], ["日本語", "テキスト"], ["е\u0301лка", "x"]]


def test_words_of_all_scripts(spark):
    docs = spark.createDataFrame([(1, LINES, "en", "s")], "doc_id int, text string, lang string, source string")
    assert [r["toks"] for r in corpus.sentences(docs).orderBy("sid").collect()] == WANT
    assert [r["sid"] for r in corpus.sentences(docs).orderBy("sid").collect()] == [1, 2, 3, 5]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents AS SELECT 1 AS doc_id, ? AS text, 'en' AS lang, 's' AS source", [LINES])
    assert [r[0] for r in c.sql(f"WITH {SENTENCES} SELECT toks FROM sents ORDER BY sid").fetchall()] == WANT
    whole = "".join(ch for ch in LINES.lower() if unicodedata.category(ch)[0] in "LMN")
    assert "".join(w for line in WANT for w in line) == whole


def test_medians_of_hot_and_odd_groups(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([None, 1.5, 2.0, rng.random() * 9])) for _ in range(2000)] + [("one", 4.0), (None, 1.0), (None, 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r["median"] for r in collection.medians(df, ["g"], "x").collect()}
    assert got == {g: statistics.median(x for h, x in rows if h == g and x is not None) for g in ("hot", "one", None)}
    out = {r["g"]: (r["med"], r["mvar"], r["n"] if "n" in r else None) for r in collection.aggregated(df, ["g"], "x", ["med", "mvar"]).where("g is not null").collect()}
    assert out["none"][:2] == (0.0, 0.0) and out["one"][:2] == (4.0, 0.0)


def test_sample_is_that_of_the_largest_keys(spark, small):
    rows = [r["w"] for r in QUERIES["roulette"](spark, small).collect()]
    uni = text.unigrams(spark, small).selectExpr("w", "f", "(pmod(xxhash64(w, 'seed'), 9007199254740992) + 1) / CAST(9007199254740993 AS DOUBLE) AS u").toPandas()
    keys = np.log(uni.u) / uni.f
    assert set(rows) == set(uni.w[np.argsort(-keys.to_numpy())[:50]])


def test_kmeans_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (30, 3)) for c in (0, 2, 5)])
    start = {0: x[0], 1: x[1], 2: x[70]}
    centres, seen = dict(start), None
    while True:
        now = [min(centres, key=lambda c: (((v - centres[c]) ** 2).mean(), c)) for v in x]
        if now == seen:
            break
        seen = now
        centres = {c: x[[k for k, n in enumerate(now) if n == c]].mean(axis=0) for c in set(now)}
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    seeds = spark.createDataFrame([(c, v.tolist()) for c, v in start.items()], "cluster int, centre array<double>")
    assert {r["id"]: r["cluster"] for r in clustering.kmeans(points, seeds).collect()} == dict(enumerate(seen))


def test_stemmer_parses_join_to_their_words(spark, small):
    for r in QUERIES["stemmer_parses"](spark, small).collect():
        parts = r["parse"].split(".")
        assert "".join(parts) == r["w"]
        at = next((i for i, p in enumerate(parts) if p not in shapes._PREFIXES), len(parts) - 1)
        assert all(re.fullmatch("|".join(shapes._PREFIXES), p) for p in parts[:at])


def test_rank_sums_of_ties(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 2.0), ("b", 5.0), ("a", None)]
    got = {r["g"]: (r["n"], r["w"]) for r in fitting.rank_sums(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    assert got == {"a": (2.0, 1 + 3.0), "b": (3.0, 3.0 + 3.0 + 5)}


def test_windows_of_a_long_line_take_time_in_proportion(spark):
    """A line of 150,000 words, and arrays with fewer items than a window."""
    n = 150_000
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")).alias("toks"))
    began = time.time()
    grams = long.select(F.explode(corpus.windows(corpus.padded("toks", 2, 1), 3)).alias("g")).select("g.*")
    assert grams.distinct().count() == n + 1
    assert time.time() - began < 60
    few = spark.createDataFrame([(["a"],), (["a", "b", "c"],), ([],)], "toks array<string>")
    assert [[list(g) for g in r[0]] for r in few.select(corpus.windows(F.col("toks"), 2)).collect()] == [[], [["a", "b"], ["b", "c"]], []]


def test_positional_counts_of_a_long_line_take_time_in_proportion(spark):
    n = 40_000
    docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")), " ").alias("text"))
    began = time.time()
    got = {r["step"]: r["count"] for r in corpus.positional_counts(corpus.sentences(docs), 3).groupBy("step").count().collect()}
    assert got == {1: n - 1, 2: n - 2, 3: n - 3} and time.time() - began < 60


def test_interpolation_counts_bigrams_once(spark, small, monkeypatch):
    real, calls = corpus.ngram_counts, []
    monkeypatch.setattr(corpus, "ngram_counts", lambda *a, **b: calls.append(a) or real(*a, **b))
    QUERIES["lr_interpolated_all"](spark, small)
    assert len(calls) == 1
