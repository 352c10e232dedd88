import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from tests.llm.conftest import sentence
from tests.oracle import connection, same
from wordloom.llm import chained_passages, embedding_dedup, exact_substrings, line_dedup, simhash, suffix_array
from wordloom.llm.common import as_list, stored
from wordloom.llm.components import connected_components
from wordloom.llm.queries import oracle_sql, queries


def components(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    want = components(501, pairs)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_with_sql(spark, small, name):
    same(queries()[name](spark, small), connection(small), oracle_sql()[name])


def slow_lines(rows):
    """Kept text by plain loops; rows of one doc_id and text count once."""
    order = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in rows if r["text"] is not None}, key=lambda x: (x[0], x[1], signed(x[2])))
    seen, out = set(), {}
    for has, i, text in order:
        lines, gone = text.split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip() for x in w):
                if w in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(w)
        out[has, i, text] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_lines_of_odd_rows(odd_docs, no_docs):
    want = slow_lines(odd_docs.collect())
    out = line_dedup.deduplicated(odd_docs)
    assert out.columns[: len(odd_docs.columns) - 1] == [c for c in odd_docs.columns if c != "n_removed"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    texts = Counter(want[r["doc_id"] is not None, r["doc_id"] or 0, r["text"]] if r["text"] is not None else None for r in odd_docs.collect())
    assert Counter(r["text"] for r in rows) == texts
    assert line_dedup.deduplicated(no_docs).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_simhash_against_brute_force(request, which):
    rows = request.getfixturevalue(which).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    prints = np.array([slow_fingerprint(r["text"]) for r in rows], np.uint64)
    pairs = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)]
    part = components(len(rows), pairs)
    want = sorted(str((r["doc_id"], f"{int(p):016x}", rows[c]["doc_id"])) for r, p, c in zip(rows, prints, part, strict=True))
    got = sorted(str(tuple(r)) for r in simhash.near_duplicates(request.getfixturevalue(which)).collect())
    assert got == want


def test_simhash_of_nothing(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_every_near_pair_shares_a_table():
    masks, rng = simhash.covering_masks(), random.Random(3)
    assert len(masks) == 15
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(x & m == 0 for m in masks)


def test_near_fingerprints_in_a_large_group(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(63)
    values = {centre ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for _ in range(1500)} | {rng.getrandbits(63) for _ in range(300)}
    rows = sorted(values)
    a = np.array(rows, np.uint64)
    want = components(len(rows), [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3)])
    got = {r["node"]: r["component"] for r in connected_components(simhash.near_edges(spark.createDataFrame([(x,) for x in rows], "fp long"))).collect()}
    assert [got.get(x, x) for x in rows] == [rows[c] for c in want]


def test_suffix_arrays():
    rng = random.Random(3)
    for few in (0, 600):
        suffix_array.FEW = few
        for _ in range(300):
            most = rng.choice([1, 2, 3, 200])
            x = [rng.randint(1, most) for _ in range(rng.randint(0, 60))] + [0]
            sa = suffix_array.suffix_array(np.array(x), most + 1)
            want = sorted(range(len(x)), key=lambda i: x[i:])
            assert sa.tolist() == want
            plcp, phi = suffix_array.common_prefixes(np.array(x), sa, 1 << 20)
            for i, j in zip(want[1:], want, strict=False):
                k = 0
                while max(i, j) + k < len(x) and x[i + k] == x[j + k]:
                    k += 1
                assert (plcp[i], phi[i]) == (k, j)
    suffix_array.FEW = 600


def slow_substrings(texts, match=400):
    count = Counter(b[i : i + match] for b in texts for i in range(len(b) - match + 1))
    out = []
    for b in texts:
        covered = np.zeros(len(b) + 1, int)
        for i in range(len(b) - match + 1):
            if count[b[i : i + match]] > 1:
                covered[i] += 1
                covered[i + match] -= 1
        covered = np.cumsum(covered)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
        out.append((len(b), int(covered.sum()), int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("which", "shard", "match"), [("documents", 1 << 20, 400), ("documents", 4000, 400), ("odd_docs", 1 << 20, 400), ("odd_docs", 3000, 400), ("documents", 1 << 20, 200), ("odd_docs", 3000, 50), ("odd_docs", 1 << 20, 19)])
def test_substrings_against_brute_force(request, monkeypatch, which, shard, match):
    monkeypatch.setattr(exact_substrings, "SHARD", shard)
    monkeypatch.setattr(exact_substrings, "FEW", 0 if shard < 1 << 20 else 2_000_000)
    docs = request.getfixturevalue(which)
    if which == "documents":
        docs = docs.where("doc_id < 60")
    rows = docs.collect()
    want = Counter((r["doc_id"], *w) for r, w in zip(rows, slow_substrings([(r["text"] or "").encode() for r in rows], match), strict=True))
    assert Counter(tuple(r) for r in exact_substrings.without_repeats(docs, texts=False, match=match).collect()) == want
    if which == "odd_docs" and match == 400:
        out = exact_substrings.without_repeats(docs)
        assert out.count() == len(rows) and set(docs.columns) - {"n_removed", "body", "spans"} <= set(out.columns)


def test_texts_and_digests_of_what_is_left(spark, small):
    for r in queries()["op9_suffix_arrays"](spark, small).where("n_removed > 0").collect():
        if len(r["text"].encode()) == r["n_bytes"] - r["n_removed"]:  # no character was cut in two
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]


def test_cells_halve():
    for match in (18, 19, 50, 200, 400, 1000):
        sizes = exact_substrings.cells(match)
        assert sizes[-1] == 1 and 2 * sizes[0] <= match - exact_substrings.GRAM and all(a % b == 0 for a, b in zip(sizes, sizes[1:], strict=False))


def test_substrings_of_nothing(no_docs):
    assert exact_substrings.without_repeats(no_docs).count() == 0


def vectors(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(40):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((centre + rng.normal(size=16) * 0.08).tolist())
    centre = rng.normal(size=16)
    rows += [(centre + rng.normal(size=16) * 0.03).tolist() for _ in range(900)]  # more than a window and a block
    rows += [rows[0], rows[0], [0.0] * 16, None, [], [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    data = [(i, v, i % 2 if i % 7 else 0) for i, v in enumerate(rows)] + [(5000, rows[0], None), (5001, rows[0], 0), (5001, rows[0], 0), (None, rows[1], 1)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")


def test_embeddings_against_brute_force(spark):
    frame = vectors(spark)
    rows = frame.collect()

    def fine(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = [np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) if fine(r["embedding"]) and r["label"] is not None else None for r in rows]
    links = [[j for j in range(len(rows)) if j != i and units[i] is not None and units[j] is not None and rows[i]["label"] == rows[j]["label"] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98] for i in range(len(rows))]
    part = components(len(rows), [(i, j) for i in range(len(rows)) for j in links[i]])
    names = {}
    for i, p in enumerate(part):
        if rows[i]["vec_id"] is not None:
            names[p] = min(names.get(p, 1 << 60), rows[i]["vec_id"])
    want = Counter((r["vec_id"], len(links[i]), names.get(part[i]), r["vec_id"] is not None and r["vec_id"] == names.get(part[i])) for i, r in enumerate(rows))
    assert Counter(tuple(r) for r in embedding_dedup.linked(frame).collect()) == want
    assert embedding_dedup.linked(frame.limit(0)).count() == 0


def test_recall_across_many_ranges(spark, monkeypatch):
    """Pairs of cosine 0.98 to 0.99 in one concentrated label, over many short ranges of the sorted table."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=48)
    rows, wanted = [], []
    for i in range(500):
        a = centre * 0.8 + rng.normal(size=48)
        a /= np.linalg.norm(a)
        off = rng.normal(size=48)
        off -= (off @ a) * a
        cosine = rng.uniform(0.981, 0.99)
        rows += [a, cosine * a + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off)]
        wanted.append((2 * i, 2 * i + 1))
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes = embedding_dedup.distinct_vectors(frame, "embedding", "label").select("node", "least", "label", "dim", "vec")
        names = {r["node"]: r["least"] for r in nodes.collect()}
        part = {names[r["node"]]: names[r["component"]] for r in connected_components(embedding_dedup.pass_edges(nodes)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    found = sum(a in part and part[a] == part.get(b) for a, b in wanted)
    assert found >= 0.98 * len(wanted)


def test_effort_follows_size_and_concentration():
    assert embedding_dedup.effort(5_000, 0.0) == (embedding_dedup.PASSES, embedding_dedup.NEIGHBOURS)
    assert embedding_dedup.effort(30_000, 0.8) == (24, 64) and embedding_dedup.effort(30_000, 0.95) == (36, 256)
    assert embedding_dedup.effort(120_000, 0.95) == (48, 512) and embedding_dedup.effort(0, 1.0)[0] > 12


def test_recall_in_a_large_concentrated_label(spark):
    """200 pairs of cosine 0.981 to 0.99 among 30,000 vectors of a mean cosine of 0.95, and a small label beside them."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((30_000, 64))
    x[:, 0] = 0
    x = np.sqrt(0.05) * x / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] = np.sqrt(0.95)
    c = rng.uniform(0.981, 0.99, 200)[:, None]
    off = rng.standard_normal((200, 64))
    off -= (off * x[:200]).sum(axis=1, keepdims=True) * x[:200]
    y = c * x[:200] + np.sqrt(1 - c**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    small = rng.standard_normal((50, 64))
    rows = [(i, v.tobytes(), 64, label) for i, (v, label) in enumerate([*((v, 1) for v in np.concatenate([x, y])), *((v / np.linalg.norm(v), 2) for v in small)])]
    nodes = spark.createDataFrame(pd.DataFrame(rows, columns=["node", "vec", "dim", "label"]), "node long, vec binary, dim int, label int").repartition(8)
    part = {r["node"]: r["component"] for r in connected_components(embedding_dedup.pass_edges(nodes)).collect()}
    found = sum(i in part and part[i] == part.get(30_000 + i) for i in range(200))
    assert found >= 0.95 * 200


def test_chains():
    x, y = np.array([0, 10, 20, 30, 5]), np.array([0, 10, 20, 30, 90])
    assert best(x, y) == [0, 1, 2, 3]


def best(x, y):
    return chained_passages.best_chains(x, y)[0]


def test_alignment_restores_ends_and_bridges_gaps():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 30, 200)
    b = a.copy()
    b[100] += 1
    b = np.delete(b, 120)
    got = chained_passages.align(a, b, [(60, 60), (130, 129)])
    assert got[:4] == (0, 200, 0, 199) and got[4] == 198
    b = np.delete(np.insert(a, 8, 5), 190)  # left out and put in beyond the anchors
    assert chained_passages.align(a, b, [(60, 61), (130, 131)])[:4] == (0, 200, 0, 200)


def test_chains_end_at_long_gaps():
    x = np.concatenate([np.arange(0, 3000, 10), np.arange(3600, 6000, 10)])
    assert sorted(map(len, chained_passages.best_chains(x, x + 5))) == [240, 300]


def words_for(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(6))


def edited(rng, passage, identity):
    """The passage with so many of its words changed, left out or put in."""
    out = list(passage)
    for at in sorted(rng.sample(range(len(out)), round(len(out) * (1 - identity))), reverse=True):
        kind = rng.random()
        out[at : at + 1] = [words_for(rng)] if kind < 0.6 else [] if kind < 0.8 else [out[at], words_for(rng)]
    return out


def linked(rows):
    return {(r["doc_id"], r["other_doc_id"]) for r in rows}


def test_recall_of_passages(spark):
    """Figures for the README: pairs found by length and identity."""
    rng, texts, planted = random.Random(21), [], {}
    for identity in (1.0, 0.95, 0.9, 0.85):
        for n in (60, 120, 300):
            for _ in range(40):
                passage = [words_for(rng) for _ in range(n)]
                a, b = len(texts), len(texts) + 1
                texts += [[words_for(rng) for _ in range(rng.randint(20, 60))] + p + [words_for(rng) for _ in range(30)] for p in (passage, edited(rng, passage, identity))]
                planted.setdefault((identity, n), []).append((a, b))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = chained_passages.passages(docs).collect()
    found = linked(rows)
    assert found <= {p for pairs in planted.values() for a, b in pairs for p in ((a, b), (b, a))}
    recall = {k: sum(p in found and p[::-1] in found for p in pairs) / len(pairs) for k, pairs in planted.items()}
    print("recall", recall)
    assert all(v == 1.0 for (identity, _), v in recall.items() if identity == 1.0)
    assert all(v >= 0.95 for (identity, _), v in recall.items() if identity == 0.95)
    assert all(v >= 0.95 for (_, n), v in recall.items() if n >= 120)
    assert recall[0.9, 60] >= 0.75  # what edits near its ends leave has fewer than 50 words


def local_passage(a, b):
    """Words of the best local alignment of two texts under +1, -3 and gaps of -3, or 0."""
    best, score, size = 0, np.zeros(len(b) + 1), np.zeros(len(b) + 1, int)
    top = 0.0
    for w in a:
        new, long = np.zeros(len(b) + 1), np.zeros(len(b) + 1, int)
        for j, v in enumerate(b, 1):
            choices = [(0.0, 0), (score[j - 1] + (1 if v == w else -3), size[j - 1] + 1), (score[j] - 3, size[j] + 1), (new[j - 1] - 3, long[j - 1])]
            new[j], long[j] = max(choices)
            if new[j] > top:
                top, best = new[j], long[j]
        score, size = new, long
    return best


def test_passages_against_all_pairs(spark):
    """Small texts that share exact and edited passages, some in more than two texts, compared pair by pair."""
    rng = random.Random(4)
    texts = [[words_for(rng) for _ in range(rng.randint(30, 60))] for _ in range(14)]
    for i, j, identity in ((0, 1, 1.0), (0, 2, 0.95), (3, 4, 0.92), (5, 6, 0.95), (7, 8, 1.0), (7, 9, 1.0), (10, 11, 0.9)):
        passage = [words_for(rng) for _ in range(65)]
        for t, p in ((i, passage), (j, edited(rng, passage, identity))):
            at = rng.randint(0, len(texts[t]))
            texts[t][at:at] = p
    texts[12][10:10] = texts[13][:40]  # too short
    want = {(i, j) for i in range(14) for j in range(14) if i != j and local_passage(texts[i], texts[j]) >= 55}
    rows = chained_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert linked(rows) == want


def test_common_phrases_hide_no_passage(spark):
    rng = random.Random(31)
    passage = [words_for(rng) for _ in range(84)]
    texts = {0: passage, 1: passage}
    for k in range(0, 84, 7):  # every phrase is quoted by many
        for _ in range(60):
            texts[len(texts)] = [words_for(rng) for _ in range(20)] + passage[k : k + 7] + [words_for(rng) for _ in range(20)]
    texts[0], texts[1] = ([words_for(rng) for _ in range(30)] + passage + [words_for(rng) for _ in range(30)] for _ in (0, 1))
    rows = chained_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    assert linked(rows) == {(0, 1), (1, 0)}
    assert {(r["start_word"], r["n_words"]) for r in rows} == {(30, 84)}


@pytest.mark.parametrize(("margin", "few"), [(40, 2_000_000), (3, 0)])
def test_every_place_of_a_passage(spark, monkeypatch, margin, few):
    monkeypatch.setattr(chained_passages, "MARGIN", margin)
    monkeypatch.setattr(chained_passages, "FEW", few)
    rng = random.Random(32)
    some = lambda n: [words_for(rng) for _ in range(n)]
    passage = some(60)
    texts = [some(10) + passage + some(20) + passage + some(5), some(40) + passage, passage + some(9), some(100)]
    rows = chained_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start_word"], r["n_words"]) for r in rows} == {(0, 10, 60), (0, 90, 60), (1, 40, 60), (2, 0, 60)}
    assert len({(r["class_doc_id"], r["class_start_word"]) for r in rows}) == 1 and (rows[0]["class_doc_id"], rows[0]["class_start_word"]) == (0, 10)


def test_passages(spark, no_docs, odd_docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(70)]
    edited = passage[:30] + ["changed"] + passage[31:55] + passage[56:]
    texts = {i: [word() for _ in range(60 + i)] for i in range(30)}
    for i, p in ((3, passage), (9, passage), (12, edited), (20, passage[:65])):
        texts[i] = texts[i][:20] + p + texts[i][20:]
    texts[25] = texts[14]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    rows = chained_passages.passages(docs).collect()
    assert {r["doc_id"] for r in rows} == {3, 9, 12, 20, 14, 25}
    for r in rows:
        if r["doc_id"] in (3, 9, 12, 20):
            assert 18 <= r["start_word"] <= 22 and 50 <= r["n_words"] <= 74 and r["identity"] >= 0.9
        else:
            assert r["n_words"] == len(texts[14]) and r["identity"] == 1.0
    assert chained_passages.passages(no_docs).count() == 0
    found = {(r["doc_id"], r["other_doc_id"]) for r in chained_passages.passages(odd_docs).collect()}
    assert (2, 1) in found and (1, 2) in found and any(3 in p for p in found) and any(10 in p for p in found)


def test_links_of_common_phrases_and_edits(spark):
    """Passages whose every phrase of 25 words is quoted by other texts, word for word and edited: no link is lost to the texts that quote a phrase."""
    rng, texts, planted = random.Random(77), [], {}
    some = lambda n: [words_for(rng) for _ in range(n)]
    for identity in (1.0, 0.95, 0.9):
        for _ in range(12):
            passage = some(100)
            planted.setdefault(identity, []).append((len(texts), len(texts) + 1))
            texts += [some(30) + passage + some(30), some(20) + edited(rng, passage, identity) + some(40)]
            texts += [some(20) + passage[k : k + 25] + some(20) for k in range(0, 100, 25) for _ in range(12)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, " ".join(texts[i])) for i in order], "doc_id long, text string").repartition(3)
    found = linked(chained_passages.passages(docs).collect())
    assert found == {p for pairs in planted.values() for a, b in pairs for p in ((a, b), (b, a))}


def test_as_list_equals_pylist():
    rows = [{"a": 1, "b": ["x", None]}, {"a": 2, "b": []}, {"a": 3, "b": None}]
    arrays = [
        pa.array([1, -2, 1 << 62]), pa.array([1, None]), pa.array(["a", None, "", "\u4e2d\0"]), pa.array([b"", b"\0x", None]), pa.array([True, False]), pa.array([0.5, None]), pa.array([0.5, -0.0]),
        pa.array([[1, 2], [], [3]]), pa.array([[1, None], None]), pa.array([["a"], ["b", "c"], []]), pa.array(rows), pa.array([[rows[0]], [], rows]), pa.array([], pa.list_(pa.int32())), pa.array([[["a"], []], []]), pa.array([None, None]),
    ]
    for a in arrays:
        for part in (a, a[1:], a[:0]):
            assert as_list(part) == part.to_pylist(), part


def test_chains_equal_all_pairs_of_anchors():
    rng = np.random.default_rng(5)
    for n in [2, 3, 8, 30] * 10:
        for rising in (True, False):
            x, y = (np.cumsum(rng.integers(1, 30, n)) if rising else rng.integers(0, 60, n) for _ in range(2))
            places = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
            x, y = np.array([p for p, _ in places]), np.array([q for _, q in places])
            score, least = [], chained_passages.K
            for i, j in places:
                # Of the anchors before, the one of the greatest score with its place, the later of equals, is followed.
                before = [(s + chained_passages.GAP_COST * (p + q), k) for k, ((p, q), s) in enumerate(zip(places, score, strict=False)) if p < i and q < j]
                most, k = max(before, default=(-1e18, 0))
                score.append(max(least, most - chained_passages.GAP_COST * (i + j) + min(least, i - places[k][0], j - places[k][1])))
            chains = chained_passages.best_chains(x, y)
            assert sorted(a for c in chains for a in c) == list(range(len(places)))
            assert abs(max(score) - max(_score([places[a] for a in c]) for c in chains)) < 1e-9


def _score(places):
    k, cost = chained_passages.K, chained_passages.GAP_COST
    return k + sum(min(k, i - p, j - q) - cost * (i - p + j - q) for (p, q), (i, j) in zip(places, places[1:], strict=False))


def test_later_rounds_read_the_texts_that_go_on(spark, monkeypatch):
    rng = random.Random(8)
    start = sentence(rng, 14) + " same" * 300
    rows = [(1, sentence(rng, 70) + " " + start + " " + sentence(rng, 50)), (2, sentence(rng, 90) + " " + start + " " + sentence(rng, 60))] + [(i, sentence(rng, 100)) for i in range(3, 30)]
    held = []

    def watched(df, name):
        out = stored(df, name)
        held.append((name, out.count()))
        return out

    monkeypatch.setattr(chained_passages, "stored", watched)
    found = chained_passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in found} == {(1, 2), (2, 1)}
    assert max(r["n_words"] for r in found) >= 310
    assert [n for name, n in held if name == "texts"] == [2]
    assert sum(name == "passages" for name, _ in held) > 2
