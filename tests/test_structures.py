"""Decompositions, restarts of k-means, acceptors, numbered trees, fits, and XML by paths and rules."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import clustering, dictionary, evaluation, fitting, morphology, normalization, profile_shapes, sparse_svd, tree_order, trie
from wordloom.sources import files


def sparse(spark, x, share, seed):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(x.shape) < share, x, 0)
    cells = [(f"r{i}", f"c{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return x, spark.createDataFrame(cells, "t string, k string, x double").repartition(3)


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, cells = sparse(spark, rng.standard_normal((60, 12)) @ np.diag(2.0 ** -np.arange(12)) @ rng.standard_normal((12, 30)), 0.4, 2)
    d = sparse_svd.decomposed(cells, 5, rounds=60)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(d.values, s[:5], rtol=1e-7)
    right = {r.k: np.array(r.v) for r in d.right.collect()}
    left = {r.t: np.array(r.v) for r in d.left.collect()}
    for j in range(5):
        v = np.array([right[f"c{i}"][j] for i in range(30)])
        assert abs(abs(v @ vt[j]) - 1) < 1e-6 and v[np.abs(v).argmax()] > 0
    assert np.allclose([left[f"r{i}"] @ (d.values * right["c3"]) for i in range(60) if f"r{i}" in left], (u[:, :5] * s[:5] @ vt[:5])[[i for i in range(60) if f"r{i}" in left], 3], atol=1e-5)
    rows = {r.t: np.array(r.v) for r in sparse_svd.applied(cells, d).collect()}
    assert all(np.allclose(rows[t], left[t], atol=1e-6) for t in rows)
    columns = {r.k: np.array(r.v) for r in sparse_svd.applied(cells, d, rows=False).collect()}
    assert all(np.allclose(columns[k], right[k], atol=1e-6) for k in columns)
    near = u[:, :5] * s[:5] @ vt[:5]
    for side, by_rows in ((d.left, True), (d.right, False)):
        for r in sparse_svd.unapplied(side, d, cells, by_rows).collect():
            assert r.x == pytest.approx(near[int(r.t[1:]), int(r.k[1:])], abs=1e-5)


def test_svd_of_odd_tables(spark):
    cells = spark.createDataFrame([("a", "x", 2.0), ("a", "x", 1.0), ("b", "y", 4.0), ("b", "x", 0.0), ("c", "x", None)], "t string, k string, x double")
    d = sparse_svd.decomposed(cells, 9)
    assert d.values.tolist() == pytest.approx([4.0, 3.0])  # repeated cells are summed, the rank is 2
    assert {r.k: [round(v, 9) for v in r.v] for r in d.right.collect()} == {"x": [0.0, 1.0], "y": [1.0, 0.0]}
    assert len(sparse_svd.decomposed(cells.limit(0), 3).values) == 0


def test_ranks():
    assert sparse_svd.rank(1000, 20) == 20 and sparse_svd.rank(10, 20) == 10
    assert sparse_svd.rank(1000, 0.1) == 100 and sparse_svd.rank(1000, -0.5) == int(0.5 + math.exp(0.5 * math.log(1000)))
    with pytest.raises(ValueError):
        sparse_svd.rank(10, 0)


@pytest.mark.parametrize(("how", "distance"), [("mean", "l2"), ("median", "l1")])
def test_restarts_equal_loops(spark, how, distance):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, (25, 3)) for c in (0, 3, 7)]).round(3)
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>").repartition(3)
    starts = clustering.hashed_starts(points, 3, 4)
    given = {r: np.array([c for _, c in sorted((k.cluster, k.centre) for k in starts.collect() if k.run == r)]) for r in range(4)}
    assigned, errors = clustering.kmeans_runs(points, starts, distance, how, rounds=30)
    got = {r: {} for r in range(4)}
    for r in assigned.collect():
        got[r.run][r.id] = r.cluster
    want, sums = {}, {}
    for run, centres in given.items():
        own = None
        while True:
            diff = x[:, None, :] - centres[None]
            far = (np.abs(diff) if distance == "l1" else diff**2).mean(axis=2)
            now = far.round(12).argmin(axis=1)
            if own is not None and (now == own).all():
                break
            own = now
            centres = np.array([(np.mean if how == "mean" else np.median)(x[own == c], axis=0) if (own == c).any() else np.full(3, 1e9) for c in range(len(centres))])
        want[run], sums[run] = dict(enumerate(own.tolist())), far.min(axis=1).sum()
    assert got == want
    assert {r.run: r.error for r in errors.collect()} == pytest.approx(sums)
    best = min(sums, key=lambda r: (round(sums[r], 9), r))
    assert {r.id: r.cluster for r in clustering.best_run(assigned, errors).collect()} == want[best]


@pytest.mark.parametrize("reverse", [False, True])
def test_sentence_acceptor(spark, reverse):
    rng = random.Random(4)
    sents = [(i, [rng.choice("ab") for _ in range(rng.randint(1, 5))]) for i in range(60)] + [(100, ["long"] * 3_000)]
    got = {(r.depth, r.first.i, r.label): r.f for r in trie.sentence_acceptor(spark.createDataFrame(sents, "i int, toks array<string>"), ["i"], "#", reverse).collect()}
    first, want = {}, {}
    for i, toks in sorted(sents):
        p = ["#", *(toks[::-1] if reverse else toks), "#"]
        for k in range(len(p)):
            first.setdefault(tuple(p[:k]) if k < 100 else (k, i), i)
    for i, toks in sents:
        p = ["#", *(toks[::-1] if reverse else toks), "#"]
        for k in range(len(p)):
            key = (k, first[tuple(p[:k]) if k < 100 else (k, i)], p[k])
            want[key] = want.get(key, 0) + 1
    assert got == want
    assert trie.sentence_acceptor(spark.createDataFrame([], "i int, toks array<string>"), ["i"], "#").count() == 0


def test_numbered_trees(spark):
    rng = random.Random(5)
    parent = {0: None, 1: None} | {i: rng.randrange(i) for i in range(2, 60)} | {60: 59} | {i: i - 1 for i in range(61, 160)}  # a long chain too
    tree = tree_order.numbered(spark.createDataFrame(list(parent.items()), "node int, parent int").repartition(3))
    children = {}
    for n, p in sorted(parent.items()):
        children.setdefault(p, []).append(n)
    pre, post, depth, size, text = {}, {}, {}, {}, []

    def walk(n, d):
        pre[n], depth[n] = len(pre), d
        text.append(f"({n}")
        for c in children.get(n, []):
            walk(c, d + 1)
        text.append(")")
        post[n] = len(post)
        size[n] = 1 + sum(size[c] for c in children.get(n, []))

    for r in children[None]:
        walk(r, 0)
    rows = tree.collect()
    assert {r.node: (r.parent, r.pre, r.post, r.depth, r["size"]) for r in rows} == {n: (parent[n], pre[n], post[n], depth[n], size[n]) for n in parent}
    assert "".join(r.piece for r in sorted(tree_order.bracketed(tree).collect(), key=lambda r: r.place)) == "".join(text)

    def above(n):
        return [] if parent[n] is None else [parent[n], *above(parent[n])]

    asked = spark.createDataFrame([(0,), (40,), (100,)], "node int")
    got = {(r.node, r.ancestor): r.up for r in tree_order.ancestors(tree, asked).collect()}
    assert got == {(n, a): k for n in (0, 40, 100) for k, a in enumerate(above(n), 1)}
    pairs = tree.select(*[F.col(c).alias(f"a_{c}") for c in tree.columns]).crossJoin(tree.where("node in (40, 100)").select(*[F.col(c).alias(f"b_{c}") for c in tree.columns]))
    assert {(r.a_node, r.b_node) for r in pairs.where(tree_order.is_ancestor("a_", "b_")).collect()} == {(a, n) for n in (40, 100) for a in above(n)}
    both = spark.createDataFrame([(40, 100), (0, 1), (5, 5), (3, 120)], "a int, b int")
    for r in tree_order.common_ancestor(tree, both).collect():
        other = {r.b, *above(r.b)}
        assert r.ancestor == next((x for x in [r.a, *above(r.a)] if x in other), None)
    assert {r.node for r in tree.where(tree_order.is_leaf()).collect()} == {n for n in parent if n not in children}
    assert tree_order.numbered(spark.createDataFrame([], "node int, parent int")).count() == 0


@pytest.mark.parametrize(("a", "b", "c"), [(2.0, 0.7, 5.0), (-3.0, -1.3, 10.0), (0.5, 2.2, -4.0)])
def test_offset_power_law(spark, a, b, c):
    points = spark.createDataFrame([(float(x), a * x**b + c) for x in range(1, 60)], "x double, y double")
    got = fitting.offset_power_law(points, "x", "y")
    assert got[:3] == pytest.approx((a, b, c), abs=1e-6) and got[3] < 1e-9


def test_offset_power_law_is_least_squares(spark):
    rng = random.Random(6)
    rows = [(x / 3, 2 * (x / 3) ** 1.5 + 1 + rng.gauss(0, 0.3)) for x in range(1, 80)]
    a, b, c, error = fitting.offset_power_law(spark.createDataFrame([*rows, (-1.0, 5.0), (2.0, None)], "x double, y double"), "x", "y")
    sse = lambda a, b, c: sum((y - a * x**b - c) ** 2 for x, y in rows)
    assert error == pytest.approx(sse(a, b, c))
    assert all(sse(a + da, b + db, c + dc) >= error for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3) for dc in (-1e-3, 0, 1e-3))


def test_gaussian_functions(spark):
    xs = [-9.0, -5.0, -3.0001, -3.0, -1.0, -1e-9, 0.0, 0.3, 2.999, 3.2, 6.0]
    normal = statistics.NormalDist(2.0, 3.0)
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", fitting.erf(F.col("x")).alias("e"), fitting.gaussian_cdf(F.col("x"), 2.0, 3.0).alias("c")).collect():
        assert r.e == pytest.approx(math.erf(r.x), abs=1e-13) and r.c == pytest.approx(normal.cdf(r.x), abs=1e-13)
    ps = [1e-12, 1e-6, 0.01, 0.02425, 0.1, 0.5, 0.77, 0.97575, 0.999999, 1 - 1e-9]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", fitting.gaussian_quantile(F.col("p"), 2.0, 3.0).alias("q"), fitting.probit(F.col("p")).alias("b")).collect():
        assert r.q == pytest.approx(normal.inv_cdf(r.p), abs=1e-6) and r.b == pytest.approx(statistics.NormalDist().inv_cdf(r.p), abs=1e-6)
    ends = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "p double").select(fitting.gaussian_quantile(F.col("p")).alias("q")).collect()
    assert [r.q for r in ends] == [float("-inf"), float("inf"), None, None]


XML = """<corpus><text><s id="1"><phrase><w pos="D"><form t="The"/><m>a</m><m>b</m></w></phrase><phrase><w pos="N"><form t="cat"/></w><w><form t="sat"/><m>c</m></w></phrase></s>
<s id="2"><phrase><w pos="X"><form t="&lt;so&gt;"/></w></phrase></s><s id="3"/></text></corpus>"""


def test_xml_by_path(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    rows = files.read_xml_by_path(spark, str(tmp_path / "a.xml"), "s", "phrase/w", text="form/@t", tag="@pos", details="m").collect()
    got = sorted([[(t.text, t.tag, t.details) for t in r.toks] for r in rows], key=len)
    assert got == [[], [("<so>", "X", [])], [("The", "D", ["a", "b"]), ("cat", "N", []), ("sat", None, ["c"])]]
    none = files.read_xml_by_path(spark, str(tmp_path / "a.xml"), "s", "nothing/w").collect()
    assert all(t.text is None for r in none for t in r.toks)


def test_xml_round_trip(spark, tmp_path):
    sents = spark.createDataFrame([([("The", "D"), ("ca<t", None)],), ([("é & x", "Y")],)], "toks array<struct<text:string,tag:string>>")
    files.write_xml(sents, str(tmp_path / "out"))
    back = files.read_xml(spark, str(tmp_path / "out"), "s", "t")
    assert sorted([(t.text, t.tag) for t in r.toks] for r in back.collect()) == [[("The", "D"), ("ca<t", None)], [("é & x", "Y")]]


def test_rules_and_types(spark):
    tokens = spark.createDataFrame([("12", "card"), ("1a", "mixed"), ("going", None), ("x", "word"), (None, None)], "w string, type string")
    rules = [("^[0-9]+$", "@N"), ("[0-9]", "#"), ("^(..+)ing$", "$1~"), ("going", "never")]
    assert [r.norm for r in normalization.by_rules(tokens, rules).collect()] == ["@N", "#a", "go~", "x", None]
    assert [r.norm for r in normalization.by_rules(tokens, []).collect()] == ["12", "1a", "going", "x", None]
    want = {"words_only": ["GOING", "X", None], "card_types": ["@CARD", "GOING", "X", None], "card_literals": ["12", "GOING", "X", None], "nonword_types": ["@CARD", "@MIXED", "GOING", "X", None], "nonword_literals": ["12", "1a", "GOING", "X", None]}
    for mode, norms in want.items():
        assert [r.norm for r in normalization.typed(tokens, mode, F.upper("w")).collect()] == norms


def test_file_lists(spark, tmp_path):
    for name in ("a", "b", "skipped"):
        (tmp_path / f"{name}.t").write_text(f"{name}\tT\n")
    (tmp_path / "list").write_text("%% names\n\n" + "".join(f"  {tmp_path}/{n}.t \n" for n in ("a", "b", "skipped", "a")))
    words = lambda **how: sorted(t.text for r in files.read_file_list(spark, str(tmp_path / "list"), **how).collect() for t in r.toks)
    assert words() == ["a", "b", "skipped"] and words(ignore="skip") == ["a", "b"] and words(select="/a", ignore="/b") == ["a"] and words(select="nothing") == []


def test_segmentations(spark):
    rows = [("unhappily", "un.happi.ly", "un.happily", 3), ("unhappily", "unhapp.ily", "un.happily", 1), ("walks", None, "walk.s", 2), ("x", "x", None, 5), ("go", "go", "go", 4)]
    got = {r.unit: r for r in evaluation.segmentation_report(spark.createDataFrame(rows, "w string, seg1 string, seg2 string, f int")).collect()}
    t = got["token"]
    assert (t.n, t.coverage1, t.coverage2, t.right, t.found, t.wanted) == (15, 13 / 15, 10 / 15, 3, 7, 4) and t.precision == pytest.approx(3 / 7)
    y = got["type"]
    assert (y.n, y.right, y.found, y.wanted, y.f1) == (4, 1, 2, 1, pytest.approx(2 / 3))
    assert evaluation.segmentation_report(spark.createDataFrame(rows[:0], "w string, seg1 string, seg2 string, f int")).count() == 0


def test_signature_filters(spark):
    stems = spark.createDataFrame([("walk", "NULL,ed,s", 3), ("talk", "NULL,ed,s", 3), ("jump", "NULL,s", 2), ("go", "es", 1), ("cat", "s", 1)], "stem string, signature string, suffixes long")
    common = {r.stem: (r.signature, r.suffixes) for r in trie.without_rare_suffixes(stems, 3).collect()}
    assert common == {"walk": ("NULL,s", 2), "talk": ("NULL,s", 2), "jump": ("NULL,s", 2), "cat": ("s", 1)}
    assert {r.stem for r in trie.without_doubtful_signatures(stems, large=3).collect()} == {"walk", "talk"}
    assert {r.stem for r in trie.without_doubtful_signatures(stems, large=2).collect()} == {"walk", "talk"}
    assert trie.without_rare_suffixes(stems.limit(0)).count() == 0


def test_dictionaries_that_grow(spark):
    known = spark.createDataFrame([("b", 0), ("a", 5)], "sym string, id long")
    new = spark.createDataFrame([("c",), ("a",), (None,), ("c",), ("é",)], "sym string")
    assert {tuple(r) for r in dictionary.grown(known, new).collect()} == {("b", 0), ("a", 5), ("c", 6), ("é", 7)}
    assert {tuple(r) for r in dictionary.grown(known.limit(0), new).collect()} == {("a", 0), ("c", 1), ("é", 2)}
    assert {tuple(r) for r in dictionary.grown(known, new.limit(0)).collect()} == {("b", 0), ("a", 5)}
    pairs = spark.createDataFrame([("a", 0), ("z", 0), ("q", 9), ("q", 7)], "sym string, id long")
    assert {tuple(r) for r in dictionary.forced(known, pairs).collect()} == {("a", 0), ("q", 7)}


def test_cell_ranks(spark):
    cells = spark.createDataFrame([("left", "a", "x", 1.0), ("left", "b", "x", 3.0), ("right", "a", "x", 1.0), ("right", "a", "y", 0.0)], "dir string, t string, b string, f double")
    rows = lambda **how: {(r.dir, r.t, r.b): r.value for r in profile_shapes.cell_ranks(cells, **how).collect()}
    keys = [("left", "a", "x"), ("left", "b", "x"), ("right", "a", "x"), ("right", "a", "y")]
    assert rows() == dict(zip(keys, [0.0, 1.0, 1.0, 0.0], strict=True)) and rows(joint=True) == dict(zip(keys, [1.5, 3.0, 1.5, 0.0], strict=True))
    assert rows(shared=False) == dict(zip(keys, [0.0, 1.0, 1.0, 0.0], strict=True)) and rows(shared=False, joint=True) == dict(zip(keys, [1.0, 3.0, 2.0, 0.0], strict=True))


def test_tree_paths_beyond_what_recursion_allows(spark):
    """A chain of 150 nodes, 2,000 below another root, a node whose parent is missing, and a cycle."""
    chain = spark.range(150).selectExpr("concat('c', id) as node", "case when id > 0 then concat('c', id - 1) end as parent")
    wide = spark.range(2_000).selectExpr("concat('w', id) as node", "case when id > 0 then concat('w', (id - 1) div 4) end as parent")
    lost = spark.createDataFrame([("x", "nowhere"), ("y", "z"), ("z", "y"), ("u", "y")], "node string, parent string")
    out = morphology.tree_paths(chain.unionByName(wide).unionByName(lost))
    assert out.where("root = 'c0'").count() == 150 and out.where("root = 'w0'").count() == 2_000 and out.count() == 2_150
    assert out.where("node = 'c149'").first().asDict() == {"node": "c149", "root": "c0", "depth": 149, "path": "/".join(f"c{i}" for i in range(150))}
    assert out.where("node = 'w1000'").first()["path"] == "w0/w3/w15/w62/w249/w1000"


def test_gaussian_quantile_of_a_share_gives_the_value_again(spark):
    """A quantile of an expression that is itself an error function, of 20,000 values."""
    share = fitting.gaussian_cdf(F.col("x"), F.lit(2.0), F.lit(3.0))
    values = spark.range(20_000).select((F.col("id") / 1000 - 8).alias("x"))
    out = values.select("x", fitting.gaussian_quantile(share, F.lit(2.0), F.lit(3.0)).alias("y"))
    assert out.where("y is null or abs(x - y) > 1e-6").count() == 0


def test_row_distances_of_odd_and_many_vectors(spark, monkeypatch):
    """Null vectors and components and other lengths have no distance; the work is done without a Column for each pair."""
    vectors = [[1.0, 2.0, 4.0], [0.5, -2.0, 1.0], None, [1.0, None, 2.0], [1.0, 2.0], [float("nan"), 0.0, 0.0], [3.0, 3.0, 3.0]]
    points = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>")
    for how, part in (("l1", abs), ("l2", lambda x: x * x)):
        monkeypatch.setitem(clustering.DISTANCES, how, None)
        got = {(r.a, r.b): r.d for r in clustering.row_distances(points.where("id % 2 = 0"), points, how).collect()}
        assert set(got) == {(a, b) for a in range(7) for b in range(a + 1, 7) if a % 2 == 0 or b % 2 == 0}
        for (a, b), d in got.items():
            x, y = vectors[a], vectors[b]
            want = None if not x or not y or None in x + y or len(x) != len(y) else sum(part(p - q) for p, q in zip(x, y, strict=True)) / len(x)
            assert d == want or (want is not None and math.isnan(want) and math.isnan(d))
