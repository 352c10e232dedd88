import pytest

from wordloom.operators import profile_shapes, trie
from wordloom.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["slots_hard", "slots_soft"])
def test_trigrams_meet_classes_and_not_all_partners(spark, small, name, monkeypatch):
    """A side of a word has six classes and the edge, whatever the number of its partners."""
    met = []
    real = profile_shapes.trigram_slots
    monkeypatch.setattr(profile_shapes, "trigram_slots", lambda pairs, *a, **b: met.append(pairs) or real(pairs, *a, **b))
    assert QUERIES[name](spark, small).count() > 0
    assert met[0].groupBy("dir", "t").count().agg({"count": "max"}).first()[0] <= 7


def test_sentence_acceptor_places_words_without_a_window(spark, monkeypatch):
    """Empty sentences, equal ones and those that part late, against a loop over their prefixes; states are stored after one shuffle."""
    rows = [(2, 1, ["a", "b", "c"]), (1, 7, ["a", "b", "d"]), (3, 1, []), (4, 1, ["a", "b", "c"]), (5, 2, ["b"] * 300), (0, 9, ["b"] * 299 + ["a"])]
    sents = spark.createDataFrame(rows, "doc_id long, sid long, toks array<string>")
    plans, real = [], trie.kept
    monkeypatch.setattr(trie, "kept", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    got = sorted((r["depth"], tuple(r["first"]), r["label"], r["f"]) for r in trie.sentence_acceptor(sents, ["doc_id", "sid"], "$").collect())
    first, f = {}, {}
    for doc, sid, toks in rows:
        p = ("$", *toks, "$")
        for k, label in enumerate(p):
            first[p[:k]] = min(first.get(p[:k], (doc, sid)), (doc, sid))
            f[p[:k], label] = f.get((p[:k], label), 0) + 1
    assert got == sorted((len(state), first[state], label, n) for (state, label), n in f.items())
    assert "Window" not in plans[0]
