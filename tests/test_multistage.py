"""Soft memberships and staged classes against plain loops."""

import collections
import random

import pytest

from wordloom.operators import multistage, soft_classes, sparse_rows
from wordloom.operators.corpus import EDGE


def corpus(seed=3, n=40):
    rng = random.Random(seed)
    kinds = [["the", "a", "my"], ["cat", "dog", "cow", "hen"], ["runs", "sits", "eats"], ["fast", "now"]]
    out = collections.Counter()
    for _ in range(n):
        sent = [EDGE, *(rng.choice(k) if rng.random() < 0.9 else rng.choice(rng.choice(kinds)) for k in kinds), EDGE]
        out.update(zip(sent, sent[1:], strict=False))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    big = corpus()
    uni = collections.Counter()
    for (a, _), f in big.items():
        if a != EDGE:
            uni[a] += f
    rows = spark.createDataFrame([(a, b, f) for (a, b), f in big.items()], "w1 string, w2 string, f long")
    return big, uni, rows, spark.createDataFrame(list(uni.items()), "w string, f long")


def top(uni, n):
    return [w for w, _ in sorted(uni.items(), key=lambda x: (-x[1], x[0]))[:n]]


def cells(big, targets):
    out = collections.Counter()
    for (a, b), f in big.items():
        if b in targets:
            out["left", b, a] += f
        if a in targets:
            out["right", a, b] += f
    return out


def shares(pairs):
    whole, out = collections.Counter(), collections.defaultdict(dict)
    for (d, t, _), f in pairs.items():
        whole[d, t] += f
    for (d, t, b), f in pairs.items():
        out[t][f"{d}:{b}"] = f / whole[d, t]
    return out


def l1(x, y):
    return round(sum(abs(x.get(k, 0) - y.get(k, 0)) for k in set(x) | set(y)), 9)


def nearest(rows, centres):
    return {t: min((l1(x, c), i) for i, c in centres.items())[1] for t, x in rows.items()}


def kmeans(rows, weights, k, rounds, first=0):
    centres = {first + i: rows[w] for i, w in enumerate([w for w in top(weights, len(weights)) if w in rows][:k])}
    own = None
    for left in range(rounds, 0, -1):
        now = nearest(rows, centres)
        if now == own or left == 1:
            return now, centres
        own, old, centres = now, centres, {}
        for i in set(own.values()):
            members = [rows[t] for t in own if own[t] == i]
            centres[i] = {k: sum(m.get(k, 0) for m in members) / len(members) for k in set().union(*members)}
    return own, old


def memberships(far, beta, betas=None):
    out = {}
    for w, ds in far.items():
        x = {c: 2 ** (-beta * (betas[w] if betas else 1) * d) for c, d in ds.items()}
        out[w] = {c: v / sum(x.values()) for c, v in x.items()}
    return out


def over_classes(pairs, soft):
    out = collections.Counter()
    for (d, t, b), f in pairs.items():
        for c, p in ({EDGE: 1.0} if b == EDGE else {f"~{c}": p for c, p in soft.get(b, {}).items()}).items():
            out[d, t, c] += f * p
    return out


def far_of(rows, centres, own=None, bonus=False):
    return {t: {i: 0.0 if bonus and own[t] == i else l1(x, c) for i, c in centres.items()} for t, x in rows.items()}


def staged(kind, big, uni, sizes, n_bounds, k, rounds, beta, by_frequency=False, bonus=False):
    """(own classes, stages, distances) by loops."""
    bounds = {*top(uni, n_bounds), EDGE}
    betas = {w: f / (sum(uni.values()) / len(uni)) for w, f in uni.items()} if by_frequency else None
    rows = shares({x: f for x, f in cells(big, set(top(uni, sizes[0]))).items() if x[2] in bounds})
    own, centres = kmeans(rows, uni, k, rounds)
    stage, far = dict.fromkeys(own, 1), far_of(rows, centres)
    for at, n in enumerate(sizes[1:], 2):
        fresh = {w for w in top(uni, n or len(uni)) if w not in own}
        pairs = over_classes(cells(big, fresh | (set() if kind == "parallel" else set(own))), memberships(far, beta, betas))
        if kind == "full":
            rows = shares(pairs)
            own, centres = kmeans(rows, uni, k, rounds)
            stage, far = dict.fromkeys(own, at), far_of(rows, centres, own, bonus)
            continue
        mixed = collections.Counter()
        for (d, t, b), f in pairs.items():
            mixed[d, f"~{own[t]}" if t in own and kind != "parallel" else t, b] += f
        rows = shares(mixed)
        if kind == "parallel":
            new, centres = kmeans(rows, uni, k, rounds, max(own.values()) + 1)
        elif kind == "attach":
            centres = {int(t[1:]): x for t, x in rows.items() if t[0] == "~"}
            rows = {t: x for t, x in rows.items() if t[0] != "~"}
            new = nearest(rows, centres)
        else:
            weights = collections.Counter()
            for (_, t, _), f in mixed.items():
                weights[t] += f / 2
            new, centres = kmeans(rows, weights, k, rounds)
            found = far_of(rows, centres, new, bonus)
            far = {w: found[f"~{c}"] for w, c in own.items()} | {t: x for t, x in found.items() if t[0] != "~"}
            stage |= {t: at for t in new if t[0] != "~"}
            own = {w: new[f"~{c}"] for w, c in own.items()} | {t: c for t, c in new.items() if t[0] != "~"}
            continue
        far |= far_of(rows, centres, new, bonus)
        own |= new
        stage |= dict.fromkeys(new, at)
    return own, stage, far


@pytest.mark.parametrize("kind", multistage.KINDS)
@pytest.mark.parametrize(("by_frequency", "bonus"), [(False, False), (True, True)])
def test_stages_equal_loops(tables, kind, by_frequency, bonus):
    big, uni, rows, counts = tables
    model = multistage.staged(kind, rows, counts, [5, 8, None], 6, 3, 3, beta=2.0, by_frequency=by_frequency, bonus=bonus)
    own, stage, far = staged(kind, big, uni, [5, 8, None], 6, 3, 3, 2.0, by_frequency, bonus)
    assert {r.w: (r.c, r.stage) for r in model.own.collect()} == {w: (c, stage[w]) for w, c in own.items()}
    assert {(r.w, r.c): r.d for r in model.far.collect()} == pytest.approx({(w, c): d for w, ds in far.items() for c, d in ds.items()}, abs=1e-8)
    assert set(own) == set(uni)
    soft = model.membership(2.0)
    assert {(r.w, r.c): r.p for r in soft.collect()} == pytest.approx({(w, c): p for w, ps in memberships(far, 2.0).items() for c, p in ps.items()}, abs=1e-8)


def test_words_of_like_neighbours_share_a_class(tables):
    _, _, rows, counts = tables
    own = {r.w: r.c for r in multistage.staged("attach", rows, counts, [8, None], 8, 4, 10).own.collect()}
    assert own["cat"] == own["dog"] == own["cow"] == own["hen"] != own["the"]


@pytest.mark.parametrize("how", sparse_rows._SUMS)
def test_sparse_distances(spark, how):
    rng = random.Random(1)
    vectors = {t: {k: rng.random() for k in rng.sample("abcdefgh", 4)} for t in "pqrstu"}
    rows = spark.createDataFrame([(t, k, x) for t, v in vectors.items() for k, x in v.items()], "t string, k string, x double")
    centres = rows.where("t < 's'").withColumnRenamed("t", "c")
    got = {(r.t, r.c): r.d for r in sparse_rows.distances(rows, centres, how).collect()}
    dense = {t: [v.get(k, 0.0) for k in "abcdefgh"] for t, v in vectors.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {"l1": lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True)), "l2": lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), "cosine": lambda a, b: 1 - dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5}[how]
    assert got == pytest.approx({(t, c): want(dense[t], dense[c]) for t in vectors for c in "pqr"}, abs=1e-8)


def test_memberships_of_odd_words(spark):
    soft = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 1, 0.0), ("c", 3, 1.0)], "w string, c int, p double")
    assert {(r.w, r.c, r.p) for r in soft_classes.n_best(soft, 1).collect()} == {("a", 1, 1.0), ("c", 3, 1.0)}  # no class, no row
    newer = spark.createDataFrame([("a", 9, 1.0), ("d", 9, 1.0)], "w string, c int, p double")
    assert {(r.w, r.c) for r in soft_classes.overwritten(soft, newer).collect()} == {("a", 9), ("b", 1), ("c", 3), ("d", 9)}
    pooled = {(r.w, r.c): r.p for r in soft_classes.pooled([(soft, 1.0), (newer, 3.0)]).collect()}
    assert pooled == pytest.approx({("a", 1): 0.125, ("a", 2): 0.125, ("a", 9): 0.75, ("c", 3): 1.0, ("d", 9): 1.0})
    counts = spark.createDataFrame([("a", 4), ("x", 1)], "w string, f long")
    assert {(r.c, r.w): r.f for r in soft_classes.emissions(soft, counts).collect()} == {(1, "a"): 2.0, (2, "a"): 2.0}
    with pytest.raises(ValueError):
        soft_classes.transitions(soft, counts, "none of these")
    assert soft_classes.n_best(soft.limit(0), 2).count() == 0


def test_class_counts_equal_cells_over_classes(spark):
    """Words with several classes, without one, as an edge, and targets that are no words of the bigrams."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    big = spark.createDataFrame([(a, b, rng.randint(1, 9)) for a in ["__$", *words] for b in [*words, "__$"] if rng.random() < 0.6], "w1 string, w2 string, f long")
    targets = spark.createDataFrame([(w,) for w in [*words[:9], "none"]], "w string")
    soft = spark.createDataFrame([(w, c, 0.25 * (c + 1)) for w in words[3:] for c in range(3) if rng.random() < 0.7], "w string, c int, p double")
    shown = lambda df: sorted((r.dir, r.t, r.b, round(r.f, 9)) for r in df.collect())
    want = shown(multistage.over_classes(multistage.cells(big, targets), soft))
    assert want and shown(multistage.class_counts(big, targets, soft)) == want


def test_no_classes_and_no_centres(spark):
    big = spark.createDataFrame([("__$", "a", 2), ("a", "b", 1)], "w1 string, w2 string, f long")
    words = spark.createDataFrame([("a",), ("b",)], "w string")
    none = spark.createDataFrame([], "w string, c int, p double")
    assert [tuple(r) for r in multistage.class_counts(big, words, none).collect()] == [("left", "a", "__$", 2.0)]
    rows, centres = spark.createDataFrame([("a", "x", 1.0)], "t string, k string, x double"), spark.createDataFrame([], "c int, k string, x double")
    assert sparse_rows.distances(rows, centres).columns == ["t", "c", "d"] and sparse_rows.distances(rows, centres).isEmpty()
