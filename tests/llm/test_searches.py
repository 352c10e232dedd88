"""Reversed search, one-bit codes and spelling groups against plain loops."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tests.oracle import connection, same
from wordloom.llm import bit_search, lexical_search, queries, spelling_groups

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def small_letters(text):
    return "".join(c.lower() if c < "\x80" else c for c in text)


def searched(docs, items, keep=10):
    """{(item, rank): (doc_id, score)} by loops over (doc_id, text) and (item_id, text)."""
    terms = [(d, collections.Counter(TERM.findall(small_letters(t or "")))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    many, places = len(terms), sum(sum(c.values()) for _, c in terms)
    df = collections.Counter(t for _, c in terms for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(TERM.findall(small_letters(t or "")))
    out = {}
    for i, wanted in asked.items():
        rows = []
        for d, c in terms:
            m = 10 + 90 * sum(c.values()) * many // places
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted & set(c))
            if score > 0 and d is not None:
                rows.append((-score, d))
        for rank, (s, d) in enumerate(sorted(rows)[:keep], 1):
            out[i, rank] = d, -s
    return out


def test_search_equals_loops(spark, odd_docs, monkeypatch):
    items = [(1, "a same lines base"), (2, None), (3, ""), (4, "é中 ONE x"), (None, "same"), (5, "!!!"), (6, "nothingholdsthis"), (1, "two SPACES"), (7, "a b c d e")]
    asked = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 as rank", "'x' as term", "0 as score").repartition(2)
    want = searched([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    assert {k[0] for k in want} == {1, 4, 7}
    for bound in (1_000, 2):  # one block and several
        monkeypatch.setattr(lexical_search, "ITEMS", bound)
        got = lexical_search.ranked(odd_docs, asked)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got.collect()} == want


def test_search_of_ties_and_large_batches(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.choice([3, 3, 3, 40])))) for i in rng.sample(range(10_000), 900)]
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(3))) for i in range(20)]
    got = lexical_search.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), keep=7)
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got.collect()} == searched(docs, items, 7)


def test_search_of_nothing(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert lexical_search.ranked(odd_docs, none).count() == lexical_search.ranked(no_docs, some).count() == 0
    assert lexical_search.ranked(odd_docs.where("text is null"), some).count() == 0


def test_counts_that_exceed_64_bits():
    n = np.array([1, 10**6], np.int64)
    assert lexical_search.damped(n, 10**13, 10**15).tolist() == [10 + 90 * x * 10**13 // 10**15 for x in n.tolist()]


def nearest(rows, keep=5):
    """{query: [(vec_id, cosine)]} by loops over (vec_id, vector)."""
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine.setdefault(i, set()).add(tuple(v))
    out = {}
    for q in fine:
        if q % 50 == 0:
            found = {}
            for mine in fine[q]:
                for i, vs in fine.items():
                    for v in vs:
                        if i != q and len(v) == len(mine):
                            a, b = (bit_search.scaled(np.array([x], float))[0] for x in (mine, v))
                            found[i] = max(found.get(i, -9), float(a @ b) / math.sqrt(float(a @ a)) / math.sqrt(float(b @ b)))
            if found:
                out[q] = sorted(((i, s) for i, s in found.items()), key=lambda x: (-round(x[1], 12), x[0]))[:keep]
    return out


def check_neighbours(df, want):
    got = collections.defaultdict(dict)
    for r in df.collect():
        assert r["rank"] not in got[r.query_id]
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want)
    for q, rows in want.items():
        assert sorted(got[q]) == list(range(1, len(rows) + 1))
        assert [got[q][k + 1][1] for k in range(len(rows))] == pytest.approx([s for _, s in rows], abs=1e-9)
        assert sum(got[q][k + 1][0] == i for k, (i, _) in enumerate(rows)) >= len(rows) - 2 and len({i for i, _ in got[q].values()}) == len(rows)


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(40, 140)]
    rows += [(150, None), (200, []), (250, [0.0] * 6), (300, [1.0, None, 1, 1, 1, 1]), (350, [float("nan")] * 6), (400, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(450, [1.0, 2.0]), (451, [2.0, 4.1]), (452, [-1.0, 0.0]), (500, [1.0, 2.0, 3.0])]  # other numbers of dimensions
    rows += [(550, [1e300, 2e300, 0, 0, 0, 1e300]), (551, [1e-300, 2e-300, 0, 0, 0, 1.1e-300])]
    rows += [(i, [1.0, 1, 1, 0, 0, 0]) for i in range(590, 612)] + [(600, [1.0, 1, 1, 0, 0, 0])]  # equal vectors, a repeated row
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 1, "x", 0.0) for i, v in rows], "vec_id long, embedding array<double>, label int, node string, code double").repartition(3)
    got = bit_search.neighbours(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    check_neighbours(got, nearest(rows))
    by = {(r.query_id, r["rank"]): r.vec_id for r in got.collect()}
    assert [by[600, k] for k in range(1, 6)] == [590, 591, 592, 593, 594]
    assert bit_search.neighbours(df.where("vec_id = 600")).count() == 0
    assert bit_search.neighbours(df.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_recall_in_many_cells_and_blocks(spark, monkeypatch, spread):
    """Vectors around 20 centres, close ones and wide ones: many cells, several blocks a cell, and cells that bounds rule out."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 32))
    rows = [(i, (centres[i % 20] + spread * rng.standard_normal(32)).tolist()) for i in range(3_000)]
    monkeypatch.setattr(bit_search, "CELL", 100)
    monkeypatch.setattr(bit_search, "BLOCK", 10_000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in bit_search.neighbours(df).collect():
        got[r.query_id].add(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-12)
    hits = 0
    for q in range(0, 3_000, 50):
        s = x @ x[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.98 * 5 * 60


def test_bounds_hold():
    """Estimates are without bias, and their bounds hold as often as ``EPSILON`` says."""
    rng = np.random.default_rng(7)
    turn = bit_search.rotation(48, bit_search.BITS)
    rest, query = rng.standard_normal((2_000, 48)), rng.standard_normal((50, 48))
    code, length, aligned = bit_search.coded(rest, turn)
    got, width = bit_search.estimates(bit_search.signs(code), length, aligned, query @ turn.T)
    error = got - query @ rest.T
    assert (np.abs(error) <= width).mean() > 0.99 and abs((error / width).mean()) < 0.01


def spelt(docs, least=7):
    """The rows of ``grouped`` by loops over (doc_id, text)."""
    import zlib

    n = collections.Counter()
    for d, text in docs:
        for m in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            m = small_letters(m)
            h = zlib.crc32(f"{'' if d is None else d}:{m}".encode())
            n[m[: h % len(m)] + m[h % len(m) + 1 :] if h % 31 == 0 else m] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= 2}
    near, shortened = {w: set() for w in n}, collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            shortened[i, rest].add(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for group in shortened.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, c, len(near[w]), form[w], n.get(form[w]), root(w)) for w, c in n.items()}


def rows_of(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_spelling_groups_equal_loops(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abÿé") for _ in range(rng.randint(6, 10))) for _ in range(300)] + ["a" * k for k in range(7, 40)] + ["ab" * k for k in range(4, 20)] + ["x" * 3_000, "x" * 3_001, "x" * 1_500 + "y" + "x" * 1_500]
    docs = [(i, " ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in rng.choices(words, k=60))) for i in range(150)]
    docs += [(1_000 + i, "commonword " * 30 + "commanword commanword comanword") for i in range(20)] + [(2_000, "commanwort commanwort commanwort")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = rows_of(spelling_groups.grouped(df))
    assert got == spelt(docs)
    assert any(f and f != r for _, _, _, f, _, r in got)  # chains of forms


def test_spelling_groups_of_odd_rows(spark, odd_docs, no_docs):
    df = odd_docs.withColumnsRenamed({"kept": "word", "spans": "n", "n_words": "form"})
    got = spelling_groups.grouped(df)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert rows_of(got) == spelt([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert spelling_groups.grouped(no_docs).count() == spelling_groups.grouped(odd_docs.where("doc_id = 5")).count() == 0


@pytest.mark.parametrize("name", ["op11_reversed_search", "op13_trie_frontier"])
def test_queries_equal_their_sql(spark, small, name):
    same(queries.queries()[name](spark, small), connection(small), queries.oracle_sql()[name])


def test_neighbours_of_the_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check_neighbours(queries.queries()["op12_one_bit_codes"](spark, small), nearest(rows))
