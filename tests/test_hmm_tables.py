import itertools
import math
import random

import numpy as np

from wordloom.operators import hmm_tables

EDGE, UNKNOWN = "__$", "@UNKNOWN"


def model(spark):
    lex = spark.createDataFrame([("x", "A", 6), ("y", "A", 1), ("y", "B", 5), ("z", "B", 2), ("z", "C", 3), (UNKNOWN, "C", 1), ("x", "C", 1)], "w string, tag string, f long")
    moves = spark.createDataFrame([(EDGE, "A", 5), (EDGE, "B", 2), ("A", "B", 4), ("B", "C", 3), ("C", "A", 2), ("A", "A", 1), ("C", EDGE, 4), ("B", EDGE, 3)], "t1 string, t2 string, f long")
    return lex, moves, hmm_tables.compiled(lex, moves)


def plain(lex, moves):
    """The same probabilities by hand."""
    f, g = {(r["w"], r["tag"]): r["f"] for r in lex.collect()}, {(r["t1"], r["t2"]): r["f"] for r in moves.collect()}
    words, tags = {w for w, _ in f}, sorted({t for _, t in f})
    b = {(w, t): (f.get((w, t), 0) + 0.01) / (sum(v for (_, u), v in f.items() if u == t) + 0.01 * len(words)) for w in words for t in tags}
    left, right = {x for x, _ in g}, {y for _, y in g}
    a = {x: {y: g.get((x, y), 0) + 0.01 for y in right if (x, y) != (EDGE, EDGE)} for x in left}
    return words, tags, b, {x: {y: v / sum(row.values()) for y, v in row.items()} for x, row in a.items()}


def paths(sentence, words, tags, b, a):
    for path in itertools.product(tags, repeat=len(sentence)):
        p = math.log(a[EDGE][path[0]]) + math.log(a[path[-1]][EDGE])
        p += sum(math.log(b[w if w in words else UNKNOWN, t]) for w, t in zip(sentence, path, strict=True)) + sum(math.log(a[x][y]) for x, y in zip(path, path[1:], strict=False))
        yield path, p


def test_emissions_of_every_word_under_every_tag(spark):
    lex, moves, _ = model(spark)
    words, tags, b, _ = plain(lex, moves)
    rows = hmm_tables.emission_grid(lex).collect()
    assert len(rows) == len(words) * len(tags) == len(b)
    got = {(r["w"], r["tag"]): r["p"] for r in rows}
    assert got.keys() == b.keys() and all(math.isclose(got[k], b[k]) for k in b)
    odd = hmm_tables.emission_grid(lex.unionByName(spark.createDataFrame([("x", None, 2)], lex.schema))).collect()
    assert len(odd) == len(words) * (len(tags) + 1)


SENTENCES = [["x"], ["x", "y", "z"], ["q", "z"], ["y", "x", "q", "z", "x"], ["z", "z"]]


def test_tagging_against_all_paths(spark, monkeypatch):
    monkeypatch.setattr(hmm_tables, "TOGETHER", 2)
    lex, moves, m = model(spark)
    told = plain(lex, moves)
    sents = spark.createDataFrame(list(enumerate(SENTENCES)), "id int, toks array<string>").repartition(2)
    best = {r["id"]: r for r in hmm_tables.tagged(sents, m, ["id"]).collect()}
    alone = {r["id"]: r for r in hmm_tables.tagged(sents, m, ["id"], "posterior").collect()}
    for i, sentence in enumerate(SENTENCES):
        every = list(paths(sentence, *told))
        path, p = max(every, key=lambda x: x[1])
        assert best[i]["tags"] == list(path) and math.isclose(best[i]["logp"], p)
        total = math.log(sum(math.exp(v) for _, v in every))
        assert math.isclose(alone[i]["logp"], total)
        for k, tag in enumerate(alone[i]["tags"]):
            share = {t: sum(math.exp(v) for x, v in every if x[k] == t) for t in told[1]}
            assert math.isclose(share[tag], max(share.values()))


def test_expected_counts_and_reestimation(spark):
    lex, moves, m = model(spark)
    told = plain(lex, moves)
    sents = spark.createDataFrame(list(enumerate(SENTENCES)), "id int, toks array<string>").repartition(2)
    got = {(r["kind"], r["i"], r["j"]): r["f"] for r in hmm_tables.expected_counts(sents, m, ["id"]).collect()}
    want: dict = {}
    for sentence in SENTENCES:
        every = list(paths(sentence, *told))
        whole = sum(math.exp(v) for _, v in every)
        for path, v in every:
            share = math.exp(v) / whole
            for key in [("start", path[0], ""), ("stop", path[-1], ""), *(("a", x, y) for x, y in zip(path, path[1:], strict=False)), *(("b", t, w) for w, t in zip(sentence, path, strict=True))]:
                want[key] = want.get(key, 0) + share
    for key, v in want.items():
        assert math.isclose(got[key], v, rel_tol=1e-9), key
    assert got["n", "", ""] == len(SENTENCES)
    better, first = hmm_tables.reestimated(sents, m, ["id"])
    _, second = hmm_tables.reestimated(sents, better, ["id"])
    assert second > first
    assert np.allclose(np.exp(better.a).sum(axis=1) + np.exp(better.stop), 1) and math.isclose(np.exp(better.start).sum(), 1)
    mass = sum(np.exp(np.array(r["e"])) for r in better.emissions.collect()) + np.exp(better.unknown)
    assert np.allclose(mass, 1)


def test_growth_restriction_and_frequencies(spark):
    lex, moves, m = model(spark)
    bigger = hmm_tables.grown(m, spark.createDataFrame([("new",), ("x",), ("newer",), ("new",)], "w string"))
    rows = {r["w"]: np.exp(np.array(r["e"])) for r in bigger.emissions.collect()}
    assert set(rows) == {"x", "y", "z", "new", "newer"}
    assert np.allclose(sum(rows.values()) + np.exp(bigger.unknown), 1) and np.allclose(rows["new"], np.exp(bigger.unknown))
    assert {(r["w"], r["tag"]) for r in hmm_tables.restricted(lex, 0.3).collect()} == {("x", "A"), ("y", "B"), ("z", "B"), ("z", "C"), (UNKNOWN, "C")}
    assert {(r["w"], r["tag"]) for r in hmm_tables.best_tags(lex, 1).collect()} == {("x", "A"), ("y", "B"), ("z", "C"), (UNKNOWN, "C")}
    p = lex.join(lex.groupBy("tag").sum("f").withColumnRenamed("sum(f)", "n"), "tag").selectExpr("w", "tag", "f / n AS p")
    back = hmm_tables.frequencies(p, lex.groupBy("tag").sum("f").withColumnRenamed("sum(f)", "n"), "tag", rounded=True)
    assert {(r["w"], r["tag"], r["f"]) for r in back.collect()} == {(r["w"], r["tag"], r["f"]) for r in lex.collect()}


def test_unknown_words_and_freezing(spark):
    lex = spark.createDataFrame([("x", "A", 6), ("y", "A", 1), ("y", "B", 3), (UNKNOWN, "B", 2)], "w string, tag string, f long")
    rows = lambda how: {(r["w"], r["tag"]): r["f"] for r in hmm_tables.with_unknown(lex, how, total=6.0).collect()}
    assert rows("none") == {("x", "A"): 6, ("y", "A"): 1, ("y", "B"): 3, (UNKNOWN, "B"): 2}
    assert rows("types") == {("x", "A"): 6, ("y", "A"): 1, ("y", "B"): 3, (UNKNOWN, "A"): 4.0, (UNKNOWN, "B"): 2.0}
    assert rows("uniform") == {("x", "A"): 6, ("y", "A"): 1, ("y", "B"): 3, (UNKNOWN, "A"): 0.01, (UNKNOWN, "B"): 2.01}
    got = {(r["w"], r["tag"]): r["f"] for r in hmm_tables.frozen(lex, "w", 2.0).collect()}
    assert math.isclose(got["y", "A"], 4 * 1 / 10) and math.isclose(got["y", "B"], 4 * 9 / 10) and got["x", "A"] == 6
    assert {(r["w"], r["tag"]): r["f"] for r in hmm_tables.frozen(lex, "tag", 1.0).collect()} == {("x", "A"): 6, ("y", "A"): 1, ("y", "B"): 3, (UNKNOWN, "B"): 2}


def test_training_over_several_corpora(spark):
    m = model(spark)[2]
    some = spark.createDataFrame(list(enumerate(SENTENCES[:3])), "id int, toks array<string>")
    more = spark.createDataFrame(list(enumerate(SENTENCES[3:])), "id int, toks array<string>")
    better, history = hmm_tables.trained([some, more], m, ["id"], rounds=4, tolerance=0.0)
    assert len(history) == 4 and all(b >= a - 1e-9 for a, b in itertools.pairwise(history))
    both = spark.createDataFrame(list(enumerate(SENTENCES)), "id int, toks array<string>")
    want = m
    for _ in range(4):
        want, logp = hmm_tables.reestimated(both, want, ["id"])
    assert np.allclose(better.a, want.a) and math.isclose(logp, history[-1])
    assert len(hmm_tables.trained([both], m, ["id"], rounds=9, tolerance=0.5)[1]) == 2
