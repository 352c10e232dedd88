import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tests.llm.test_duplicates import components, slow_lines, slow_substrings
from wordloom.llm import near_copies, simhash, tiles


def test_stages_follow_each_other(spark, small, documents):
    from wordloom.llm.common import stored

    docs, columns = documents, documents.columns
    for name, stage in pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, small), "test")
        assert out.columns == columns and 0 < out.count() <= docs.count(), name
        assert out.where("length(text) <> n_chars").isEmpty()
        docs = out
    packed = pipeline.STAGES[-1][1](spark, docs, small)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert sorted(map(tuple, pipeline.run(spark, small).collect())) == sorted(map(tuple, packed.collect()))


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES[:-1]])
def test_stages_take_odd_and_no_rows(spark, small, odd_docs, no_docs, stage):
    out = stage(spark, odd_docs, small)
    assert out.columns == odd_docs.columns
    assert out.count() <= odd_docs.count()
    assert stage(spark, no_docs, small).count() == 0


def test_one_of_each_group_stays(spark, small, documents):
    twice = documents.unionByName(documents.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars"))
    once = {r["doc_id"] for r in pipeline.near_duplicates(spark, documents, small).collect()}
    assert {r["doc_id"] for r in pipeline.near_duplicates(spark, twice, small).collect()} == once


def test_documents_without_and_with_one_id(spark, small):
    words = [f"word{i}" for i in range(40)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "changed"]), " ".join(reversed(words))
    rows = [(None, text, "a"), (3, near, "b"), (3, other, "c"), (3, other, "c"), (5, other, "d"), (None, "alone here", "e"), (None, "alone here", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mark0 string")
    kept = pipeline.near_duplicates(spark, docs, small)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(3, near, "b"), (3, other, "c"), (None, "alone here", "e")]))


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def near_pairs(rng, per_level):
    """Pairs of texts by level: about 0.8, 0.9 and 0.95 alike, none below it, and just below 0.8."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = {0.95: [], 0.9: [], 0.8: [], 0.0: []}
    while any(len(v) < per_level for v in out.values()):
        a = [word() for _ in range(rng.choice([60, 100, 400]))]
        b = list(a)
        for _ in range(rng.randint(1, max(2, len(b) // 30))):
            at = rng.randrange(len(b))
            b[at : at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
        texts = " ".join(a), " ".join(b)
        j = jaccard(*map(shingle_set, texts))
        level = next((x for x, top in ((0.95, 0.97), (0.9, 0.92), (0.8, 0.82), (0.0, 0.8)) if x <= j < top and j > 0.6), None)
        if level is not None and len(out[level]) < per_level:
            out[level].append(texts)
    return out


def test_recall_of_near_copies(spark, small):
    levels = near_pairs(random.Random(12), 150)
    pairs = [(level, texts) for level, some in levels.items() for texts in some]
    rows = [(2 * i + k, texts[k]) for i, (_, texts) in enumerate(pairs) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, small).collect()}
    assert all(2 * i in kept for i in range(len(pairs)))
    gone = {level: sum(2 * i + 1 not in kept for i, (x, _) in enumerate(pairs) if x == level) / len(some) for level, some in levels.items()}
    assert gone == {0.95: 1.0, 0.9: 1.0, 0.8: 1.0, 0.0: 0.0}


@pytest.mark.parametrize("block", [512, 8])
def test_groups_against_brute_force(spark, monkeypatch, block):
    rng = random.Random(3)
    monkeypatch.setattr(tiles, "BLOCK_ROWS", block)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    texts = ["", " ", None, "One two", "one TWO", "three"]
    for _ in range(120):  # a chain of copies of copies, hanging together by some links only
        base = list(base)
        base[rng.randrange(len(base))] = word()
        texts.append(" ".join(base))
        if rng.random() < 0.5:
            base[rng.randrange(len(base))] = word()
    rng.shuffle(texts)
    sets = [shingle_set(t or "") for t in texts]
    part = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    rows = near_copies.groups_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert [got[i] for i in range(len(texts))] == part


def test_covering_masks_find_near_copies(spark, small):
    """Among the keys that the stage joins texts by are operator 10's: every pair within its bits shares one of them."""
    pairs = near_pairs(random.Random(5), 30)[0.95]
    rows = [(2 * i + k, texts[k]) for i, texts in enumerate(pairs) for k in (0, 1)]
    prints = [simhash.majority(near_copies.shingles(w)) for w in near_copies.word_hashes([t for _, t in rows])]
    near = [i for i in range(len(pairs)) if bin(prints[2 * i] ^ prints[2 * i + 1]).count("1") <= simhash.RADIUS]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many = len(simhash.covering_masks())
    keys = {r["doc_id"]: r["keys"] for r in near_copies._keyed(docs).collect()}
    assert all(len(k) == many + near_copies.BANDS for k in keys.values())
    assert near and all(any(a == b for a, b in zip(keys[2 * i][:many], keys[2 * i + 1][:many], strict=True)) for i in near)
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, small).collect()}
    assert all(2 * i in kept and 2 * i + 1 not in kept for i in near)


def test_links_of_a_block():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    sets = [np.unique(rng.choice(base[: rng.choice([300, 20_000])], rng.integers(0, 400))) for _ in range(40)] + [np.unique(base[:n]) for n in (80, 100, 125, 9_000, 10_000)]
    want = [[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for b in sets] for a in sets]
    assert near_copies.links(sets).tolist() == want == [[near_copies.alike(a, b) for b in sets] for a in sets]


def test_dedup_stages_against_brute_force(spark, small, documents):
    rows = [r.asDict() for r in documents.where("doc_id < 25").collect()]
    rng = random.Random(6)
    for i in range(0, 25, 5):  # near copies of every fifth document
        words = rows[i]["text"].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append(rows[i] | {"doc_id": 1000 + i, "text": " ".join(words), "n_chars": len(" ".join(words))})
    docs = spark.createDataFrame(rows, documents.schema)
    kept = {k[1]: text for k, text in slow_lines(rows).items() if text.strip()}
    out = pipeline.line_windows(spark, docs, small)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == kept
    ids = sorted(kept)
    sets = [shingle_set(kept[i]) for i in ids]
    part = components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    left = {ids[i]: kept[ids[i]] for i in set(part)}
    near = pipeline.near_duplicates(spark, out, small)
    assert {r["doc_id"]: r["text"] for r in near.collect()} == left
    removed = dict(zip(left, slow_substrings([t.encode() for t in left.values()], pipeline.MATCH), strict=True))
    last = {r["doc_id"]: r["text"] for r in pipeline.repeated_substrings(spark, near, small).collect()}
    for i, (n, gone, _, sha) in removed.items():
        if not gone:
            assert last[i] == left[i]
        elif i not in last:
            assert n == gone
        else:
            assert len(last[i].encode()) == n - gone and hashlib.sha256(last[i].encode()).hexdigest() == sha
