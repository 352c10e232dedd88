import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import scalar
from wordloom.operators import clustering, collection, dictionary, distribution, evaluation, trie
from wordloom.operators.corpus import EDGE, ngram_counts
from wordloom.sources import files
from wordloom.streaming import counts


def dist(spark, pairs):
    return spark.createDataFrame(pairs, "w string, f long")


def test_distribution_properties(spark):
    d = dist(spark, [("a", 4), ("b", 2), ("c", 2), ("d", 0)])
    assert math.isclose(distribution.normalized(d).agg(F.sum("p")).first()[0], 1.0)
    assert math.isclose(distribution.entropy(d).first()["h"], 1.5)
    assert {(r["w"], r["rank"]) for r in distribution.average_ranks(d).collect()} == {("a", 0.0), ("b", 1.5), ("c", 1.5), ("d", 3.0)}
    assert [r["rank"] for r in distribution.unique_ranks(d).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert {(r["w"], r["f"]) for r in distribution.folded(dist(spark, [("a", 9), ("b", 1), ("@UNKNOWN", 7)]), F.col("f") >= 5).collect()} == {("a", 9), ("@UNKNOWN", 1)}


def test_empty_distribution(spark):
    d = dist(spark, [])
    assert distribution.unique_ranks(d).count() == 0
    assert distribution.normalized(d).count() == 0
    assert distribution.count_counts(d).count() == 0


def test_divergence_of_unlike_domains(spark):
    a, b = dist(spark, [("x", 1), ("y", 1)]), dist(spark, [("x", 1), ("z", 3)])
    r = distribution.divergence(a, b).first()
    assert r["common"] == 1 and r["differ"] == 1
    assert math.isclose(r["kl"], 0.5 * math.log2(0.5 / 0.25))


def test_dictionary_round_trip(spark):
    words = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "w string")
    assert [(r["sym"], r["id"]) for r in dictionary.dictionary(words, "w").orderBy("id").collect()] == [("a", 0), ("b", 1)]


def test_trigram_windows_have_both_edges(spark):
    sents = spark.createDataFrame([(["x"],)], "toks array<string>")
    assert {tuple(r)[:3] for r in ngram_counts(sents, 3).collect()} == {(EDGE, EDGE, "x"), (EDGE, "x", EDGE), ("x", EDGE, EDGE)}


def test_scalar_functions(spark):
    row = spark.createDataFrame([([1, 1, 2, 1], 2.0)], "a array<long>, x double").select(
        scalar.run_lengths(F.col("a")).alias("r"), scalar.log2_or_zero(F.col("x")).alias("l"), scalar.round_half_up(F.lit(2.5)).alias("h"), scalar.binomial_probability(F.lit(4), F.lit(2), F.lit(0.5)).alias("b"), scalar.plain_name(F.lit("a (b) c")).alias("n")
    ).first()
    assert [(x["value"], x["many"]) for x in row["r"]] == [(1, 2), (2, 1), (1, 1)]
    assert (row["l"], row["h"], row["n"]) == (1.0, 3, "a_b_c") and math.isclose(row["b"], 0.375)


def test_collection_set_operations(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert {tuple(r) for r in collection.clobbered(left, right, "k").collect()} == {(1, "a"), (2, "c")}
    assert {tuple(r) for r in collection.removed(left, right, "k").collect()} == {(1, "a")}


def test_aggregates_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("g", None), ("g", 3.0), ("g", 0.0), ("n", None)], "g string, x double")
    out = {r["g"]: r.asDict() for r in collection.aggregated(rows, ["g"], "x", [*collection.AGGREGATES, "avgdev", "amdev"]).collect()}
    assert (out["g"]["count"], out["g"]["ndefined"], out["g"]["nnz"], out["g"]["nvalues"]) == (3, 2, 1, 3)
    assert (out["n"]["sum"], out["n"]["prod"], out["n"]["avg"], out["n"]["med"], out["n"]["amdev"]) == (0.0, 1.0, 0.0, 0.0, 0.0)


def greedy(x, link):
    """[(a, b, height, size)] by merging the nearest two clusters at a time."""
    members = {i: [i] for i in range(len(x))}
    d = {(i, j): round(float(np.abs(x[i] - x[j]).mean()), 12) for i in range(len(x)) for j in range(i + 1, len(x))}
    out = []
    while d:
        height, (a, b) = min((v, k) for k, v in d.items())
        out.append((a, b, height, len(members[a]) + len(members[b])))
        for c in set(members) - {a, b}:
            one, two = d[min(a, c), max(a, c)], d.pop((min(b, c), max(b, c)))
            d[min(a, c), max(a, c)] = round({"average": (len(members[a]) * one + len(members[b]) * two) / (len(members[a]) + len(members[b])), "minimum": min(one, two), "maximum": max(one, two)}[link], 12)
        del d[a, b]
        members[a] += members.pop(b)
    return out


@pytest.mark.parametrize("link", clustering.LINKS)
def test_agglomeration_equals_greedy_merging(spark, link):
    x = np.random.default_rng(4).normal(size=(24, 3))
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>").repartition(3)
    tree = clustering.merges(points, "l1", link)
    got, want = sorted(tuple(r) for r in tree.collect()), sorted(greedy(x, link))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])
    label = list(range(24))
    for a, b, _, _ in sorted(want, key=lambda r: (r[2], r[3], r[0], r[1]))[: 24 - 5]:
        label = [a if c == b else c for c in label]
    names = {c: k for k, c in enumerate(sorted(set(label)))}
    assert {r.id: r.cluster for r in clustering.cut(points, tree, 5).collect()} == {i: names[c] for i, c in enumerate(label)}


def test_agglomeration_of_ties_and_buckshot(spark):
    points = [[0.0, 0], [0.1, 0], [5, 5], [5.1, 5], [9, 0], [9, 0], [9, 0]]
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, v array<double>")
    by = {r["id"]: r["cluster"] for r in clustering.cut(rows, clustering.merges(rows), 3).collect()}
    assert by == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2}
    assert clustering.merges(rows.limit(1)).count() == clustering.merges(rows.limit(0)).count() == 0
    assert len({r["cluster"] for r in clustering.buckshot(rows, 3).collect()}) == 3
    assert clustering.prototypes(500, 10) == 71 and clustering.prototypes(2, 10) == 10


def test_trie_and_signatures(spark):
    words = spark.createDataFrame([(w,) for w in ("walks", "walked", "walking", "talks", "talked", "talking", "walk", "talk")], "w string")
    cuts = trie.successor_cuts(words)
    found = {r["stem"]: r["signature"] for r in trie.signatures(words, cuts).collect()}
    assert found["walk"] == found["talk"] == "NULL,ed,ing,s"
    assert trie.prefixes(words.withColumn("f", F.lit(1))).where("prefix = 'walk'").first()["f"] == 4


def test_boundaries(spark):
    pairs = spark.createDataFrame([([1, 3], [3]), ([2], [2, 5])], "a array<int>, b array<int>")
    r = evaluation.boundary_scores(pairs, "a", "b").first()
    assert (r["right"], r["found"], r["wanted"]) == (2, 3, 3)


def test_tt_files(spark, tmp_path):
    (tmp_path / "a.ttt").write_text("%% comment\nDie\tART\tx\nKatze \tNN\n\nEnde\n")
    rows = files.read_corpus(spark, f"tt:{tmp_path}/a.ttt").orderBy("sid").collect()
    assert [[(t["text"], t["tag"], t["details"]) for t in r["toks"]] for r in rows] == [[("Die", "ART", ["x"]), ("Katze", "NN", [])], [("Ende", None, [])]]
    out = str(tmp_path / "out")
    files.write_tt(files.read_tt(spark, f"{tmp_path}/a.ttt").coalesce(1), out, ["sid"])
    again = files.read_tt(spark, out).orderBy("sid").collect()
    assert [r["toks"] for r in again] == [r["toks"] for r in rows]


def test_separated_files(spark, tmp_path):
    (tmp_path / "b.brown").write_text("and/or/cc the/at\n\nend/nn\n")
    rows = files.read_corpus(spark, str(tmp_path / "b.brown")).orderBy("sid").collect()
    assert [[(t["text"], t["tag"]) for t in r["toks"]] for r in rows] == [[("and/or", "cc"), ("the", "at")], [("end", "nn")]]
    (tmp_path / "c.lob").write_text("^ the_at end_nn\n")
    assert [[t["text"] for t in r["toks"]] for r in files.read_corpus(spark, str(tmp_path / "c.lob")).collect()] == [["the", "end"]]


def test_xml_files(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<c><s><t tag="a">x</t><t tag="b">y</t></s></c>')
    assert [[(t["text"], t["tag"]) for t in r["toks"]] for r in files.read_corpus(spark, str(tmp_path / "d.xml")).collect()] == [[("x", "a"), ("y", "b")]]


def test_model_files(spark, tmp_path):
    d = dist(spark, [("a b", 3), ("c", 1)])
    files.write_distribution(d, str(tmp_path / "dist"))
    assert {tuple(r) for r in files.read_distribution(spark, str(tmp_path / "dist")).collect()} == {("a b", 3.0), ("c", 1.0)}
    lex = spark.createDataFrame([("w", "A", 2), ("w", "B", 1)], "w string, tag string, f long")
    files.write_lexicon(lex, str(tmp_path / "lex"))
    assert {tuple(r) for r in files.read_lexicon(spark, str(tmp_path / "lex")).collect()} == {("w", "A", 2.0), ("w", "B", 1.0)}
    grams = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "b", 3)], "w1 string, w2 string, f long")
    files.write_ngrams(grams, str(tmp_path / "grams"), 2)
    assert {tuple(r) for r in files.read_ngrams(spark, str(tmp_path / "grams"), 2).collect()} == {("a", "b", 1.0), ("a", "c", 2.0), ("b", "b", 3.0)}
    (tmp_path / "table.dat").write_text("#1(name)\tn_2\tname\nx\t1\ty\n")
    assert files.read_table(spark, str(tmp_path / "table.dat")).first().asDict() == {"name": "x", "n": "1", "name(2)": "y"}
    (tmp_path / "v.mak").write_text("a ?= 1 # c\nb = x \\\n  y\n")
    assert {tuple(r) for r in files.read_variables(spark, str(tmp_path / "v.mak")).collect()} == {("a", "?=", "1"), ("b", "=", "x y")}


def test_streaming_counts(spark, small):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{small}/documents*.parquet")
    q = counts.word_counts(stream).writeStream.outputMode("complete").format("memory").queryName("word_counts").start()
    q.processAllAvailable()
    q.stop()
    batch = counts.word_counts(spark.read.parquet(f"{small}/documents.parquet"))
    assert spark.table("word_counts").exceptAll(batch).count() == 0 and spark.table("word_counts").count() == batch.count()
