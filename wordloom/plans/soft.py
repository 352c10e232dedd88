"""Queries over soft memberships, the models made of them, and classes found in stages.

Memberships are those of the 200 most frequent words in six classes, by the
distances of their neighbours' distributions to those of the six most frequent words.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import kept
from ..operators import corpus, multistage, profile_shapes, soft_classes
from .registry import query
from .text import counted, sents

_SHARES = "{0}s AS (SELECT t, dir || ':' || b AS k, f / sum(f) OVER (PARTITION BY dir, t) AS x FROM {0})"
_FAR = """{0}a AS (SELECT t, sum(x) AS a FROM {1} GROUP BY t), {0}b AS (SELECT c, sum(x) AS b FROM {2} GROUP BY c),
{0}j AS (SELECT {1}.t, {2}.c, sum(abs({1}.x - {2}.x) - {1}.x - {2}.x) AS s FROM {1} JOIN {2} ON {1}.k = {2}.k GROUP BY ALL),
{0} AS (SELECT {0}a.t AS w, {0}b.c AS c, round(greatest(a + b + coalesce(s, 0), 0), 9) AS d FROM {0}a CROSS JOIN {0}b LEFT JOIN {0}j ON {0}j.t = {0}a.t AND {0}j.c = {0}b.c)"""
_SOFT = f""", tg AS (SELECT w FROM uni ORDER BY f DESC, w LIMIT 200), lb AS (SELECT w FROM (SELECT w FROM uni ORDER BY f DESC, w LIMIT 100) UNION ALL SELECT '__$'),
sides AS (SELECT 'left' AS dir, w2 AS t, w1 AS b, f FROM big UNION ALL SELECT 'right', w1, w2, f FROM big),
ce AS (SELECT * FROM sides WHERE t IN (SELECT w FROM tg) AND b IN (SELECT w FROM lb)), {_SHARES.format("ce")},
st AS (SELECT row_number() OVER (ORDER BY f DESC, w) - 1 AS c, w FROM uni WHERE w IN (SELECT t FROM ces) ORDER BY f DESC, w LIMIT 6), cn AS (SELECT c, k, x FROM st JOIN ces ON t = w),
{_FAR.format("ds", "ces", "cn")},
me AS MATERIALIZED (SELECT w, c, power(2.0, -3 * d) / sum(power(2.0, -3 * d)) OVER (PARTITION BY w) AS p FROM ds),
ow AS MATERIALIZED (SELECT w, c FROM (SELECT w, c, row_number() OVER (PARTITION BY w ORDER BY d, c) AS r FROM ds) WHERE r = 1),
mk AS (SELECT w, c FROM (SELECT w, c, row_number() OVER (PARTITION BY w ORDER BY p DESC, c) AS r FROM me) WHERE r <= 3),
bt AS (SELECT w, f / avg(f) OVER () AS beta FROM uni)"""


def _model(s, d):
    """(bigrams, unigrams, model): one assignment to the profiles of the six most frequent words."""
    uni, big = counted(s, d)
    top = lambda n: uni.orderBy(F.desc("f"), "w").limit(n).select("w")
    return big, uni, multistage._first(big, uni, top(200), 100, 6, 1, "l1")[0]


def _soft(s, d):
    big, uni, model = _model(s, d)
    return big, uni, model, kept(model.membership(3.0), "membership")


def _rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


@query("soft_membership", _SOFT + " SELECT w, CAST(c AS INTEGER) AS c, round(p, 6) + 0.0 AS p FROM me", "big")
def _(s, d):
    return _rounded(_soft(s, d)[3], "p")


@query("soft_best", _SOFT + " SELECT w, CAST(c AS INTEGER) AS c, round(p / sum(p) OVER (PARTITION BY w), 6) + 0.0 AS p FROM me JOIN mk USING (w, c)", "big")
def _(s, d):
    """The three likeliest classes of each word."""
    return _rounded(soft_classes.n_best(_soft(s, d)[3], 3), "p")


_SHARPENED = "(SELECT w, c, x / sum(x) OVER (PARTITION BY w) AS p FROM (SELECT w, c, {} AS x FROM me JOIN uni USING (w) JOIN bt USING (w)))"
_EMISSIONS = {
    "invert": ({}, "me"),
    "sim": ({"mode": "sim"}, "me"),
    "power": ({"bonus": "power", "n": 4}, _SHARPENED.format("power(p, 4)")),
    "power_beta": ({"bonus": "power_over_beta", "n": 40}, _SHARPENED.format("power(p, 40 / beta)")),
    "power_beta_plus": ({"bonus": "power_over_beta_plus", "n": 3, "more": 0.5}, _SHARPENED.format("power(p, 3 * (1 / beta + 0.5))")),
    "power_frequency": ({"bonus": "power_over_frequency", "n": 500}, _SHARPENED.format("power(p, 500.0 / f)")),
    "sim_power": ({"mode": "sim", "bonus": "power", "n": 2}, _SHARPENED.format("power(p, 2)")),
    "own": ({"own": True, "n": 2}, "(SELECT w, c, (p + CASE WHEN ow.c IS NULL THEN 0 ELSE 2 END) / 3 AS p FROM me LEFT JOIN ow USING (w, c))"),
    "masked": ({"best": 3, "bonus": "power", "n": 2}, "(SELECT w, c, p / sum(p) OVER (PARTITION BY w) AS p FROM (SELECT w, c, power(p, 2) AS p FROM me JOIN mk USING (w, c)))"),
    "sim_masked": ({"mode": "sim", "best": 3}, "(SELECT w, c, p FROM me JOIN mk USING (w, c))"),
}


def _add_emissions(name: str, options: dict, rows: str) -> None:
    f = "x.p" if options.get("mode") == "sim" else "x.p * uni.f"

    @query(f"emissions_{name}", _SOFT + f" SELECT CAST(x.c AS INTEGER) AS c, x.w AS w, round({f}, 5) + 0.0 AS f FROM {rows.replace('ow.c IS NULL', 'ow.w IS NULL')} x JOIN uni ON uni.w = x.w", "big")
    def _(s, d):
        _, uni, model, soft = _soft(s, d)
        given = options | ({"own": model.own} if "own" in options else {}) | ({"beta": multistage.frequency_betas(uni)} if "beta" in options.get("bonus", "") else {})
        return _rounded(soft_classes.emissions(soft, uni, **given), "f", digits=5)


for _name, (_options, _rows) in _EMISSIONS.items():
    _add_emissions(_name, _options, _rows)

_EXPECTED = ", kn AS (SELECT w, CAST(c AS VARCHAR) AS c, p FROM {} UNION ALL SELECT '__$', '__$', 1.0) SELECT a.c AS c1, b.c AS c2, round(sum(a.p * f * b.p), 4) + 0.0 AS f FROM big JOIN kn a ON w1 = a.w JOIN kn b ON w2 = b.w WHERE a.c <> '__$' OR b.c <> '__$' GROUP BY a.c, b.c"
_MASS = ", em AS (SELECT CAST(c AS VARCHAR) AS c, sum(p * f) AS f FROM me JOIN uni USING (w) GROUP BY c)"
_TRANSITIONS = {
    "estimate": ({"best": 3}, _EXPECTED.format("(SELECT w, c, p / sum(p) OVER (PARTITION BY w) AS p FROM me JOIN mk USING (w, c))")),
    "estimate1": ({}, _EXPECTED.format("(SELECT w, c, 1.0::DOUBLE AS p FROM ow)")),
    "estimateb": ({}, _MASS + " SELECT a.c AS c1, b.c AS c2, round(b.f / ((SELECT count(*) FROM em) + 1), 4) + 0.0 AS f FROM (SELECT c FROM em UNION ALL SELECT '__$') a, em b UNION ALL SELECT c, '__$', 1.0 FROM em"),
    "uniform": ({}, _MASS + " SELECT a.c AS c1, b.c AS c2, 1.0::DOUBLE AS f FROM (SELECT c FROM em UNION ALL SELECT '__$') a, em b UNION ALL SELECT c, '__$', 1.0 FROM em"),
}


def _add_transitions(mode: str, options: dict, sql: str) -> None:
    @query(f"transitions_{mode}", _SOFT + sql, "big")
    def _(s, d):
        big, uni, model, soft = _soft(s, d)
        emitted = soft_classes.emissions(soft, uni) if mode == "estimateb" else None
        return _rounded(soft_classes.transitions(soft, big, mode, own=model.own, emitted=emitted, **options), "f", digits=4)


for _name, (_options, _rows) in _TRANSITIONS.items():
    _add_transitions(_name, _options, _rows)


@query("soft_unknown", _SOFT + " SELECT CAST(c AS INTEGER) AS c, round(0.1 * count(*) / (SELECT count(*) FROM ow), 9) AS p FROM ow GROUP BY c", "big")
def _(s, d):
    """A tenth of an unknown word's mass by the sizes of the classes."""
    return _rounded(soft_classes.unknown_by_types(_model(s, d)[2].own, 0.1), "p", digits=9)


@query("soft_restricted", _SOFT + " SELECT CAST(c AS INTEGER) AS c, w, round(f, 5) AS f FROM (SELECT c, w, p * f AS f, row_number() OVER (PARTITION BY w ORDER BY p DESC, c) AS r FROM me JOIN uni USING (w) WHERE p * f > 5) WHERE r <= 2", "big")
def _(s, d):
    """The two classes that emit a word most, above five times."""
    _, uni, _, soft = _soft(s, d)
    return _rounded(soft_classes.restricted(soft_classes.emissions(soft, uni), 2, 5.0), "f", digits=5)


@query("soft_labels", _SOFT + ", k AS (SELECT me.c, w, row_number() OVER (PARTITION BY me.c ORDER BY round(p * f, 6) DESC, w) AS k FROM me JOIN ow USING (w, c) JOIN uni USING (w)) SELECT CAST(c AS INTEGER) AS c, c || '_' || string_agg(w, '_' ORDER BY k) AS label FROM k WHERE k <= 2 GROUP BY c", "big")
def _(s, d):
    _, uni, model, soft = _soft(s, d)
    return soft_classes.labels(_rounded(soft_classes.emissions(soft, uni), "f"), model.own)


_CLASSED = """, fr AS (SELECT w FROM (SELECT w FROM uni ORDER BY f DESC, w LIMIT 400) WHERE w NOT IN (SELECT w FROM ow)),
kn AS (SELECT w, '~' || c AS b, p FROM me UNION ALL SELECT '__$', '__$', 1.0),
oc AS (SELECT dir, t, kn.b AS b, sum(f * p) AS f FROM sides JOIN kn ON kn.w = sides.b WHERE t IN (SELECT w FROM fr) OR t IN (SELECT w FROM ow) GROUP BY ALL)"""
_PSEUDO = _CLASSED + ", dp AS (SELECT dir, coalesce('~' || ow.c, t) AS t, b, sum(f) AS f FROM oc LEFT JOIN ow ON ow.w = t GROUP BY ALL)"


def _stage(s, d):
    """(bigrams, unigrams, model, membership, words of the second stage)."""
    big, uni, model, soft = _soft(s, d)
    ranked = uni.orderBy(F.desc("f"), "w").limit(400).select("w")
    return big, uni, model, soft, kept(ranked.join(model.own.select("w"), "w", "left_anti"), "fresh")


@query("stage_bounds", _SOFT + _CLASSED + " SELECT dir, t, b, round(f, 4) + 0.0 AS f FROM oc", "big")
def _(s, d):
    """The neighbours of 400 words by the classes of those which have some, edges as they are."""
    big, _, model, soft, fresh = _stage(s, d)
    return _rounded(multistage.over_classes(multistage.cells(big, fresh.unionByName(model.own.select("w"))), soft), "f", digits=4)


@query("stage_pseudo_targets", _SOFT + _PSEUDO + " SELECT dir, t, b, round(f, 4) + 0.0 AS f FROM dp", "big")
def _(s, d):
    """The same with each old class in the place of its words, as deep stages cluster it."""
    big, _, model, soft, fresh = _stage(s, d)
    pairs = multistage.over_classes(multistage.cells(big, fresh.unionByName(model.own.select("w"))), soft)
    return _rounded(multistage.with_pseudo_targets(pairs, model.own), "f", digits=4)


_ATTACH = f"""{_PSEUDO}, {_SHARES.format("dp")}, pc AS (SELECT CAST(substr(t, 2) AS INTEGER) AS c, k, x FROM dps WHERE t LIKE '~%'), pn AS (SELECT * FROM dps WHERE t NOT LIKE '~%'), {_FAR.format("df", "pn", "pc")},
nw AS (SELECT w, c FROM (SELECT w, c, row_number() OVER (PARTITION BY w ORDER BY d, c) AS r FROM df) WHERE r = 1)"""


@query("stage_attach", _SOFT + _ATTACH + " SELECT w, CAST(c AS INTEGER) AS c, 1 AS stage FROM ow UNION ALL SELECT w, CAST(c AS INTEGER), 2 FROM nw", "big")
def _(s, d):
    """200 words, and 200 more attached to the classes of these."""
    big, uni, model, _, fresh = _stage(s, d)
    return multistage.next_stage("attach", model, big, uni, fresh, 2, 6, beta=3.0).own


@query("stage_merged", _SOFT + _ATTACH + ", al AS (SELECT w, c, d FROM ds UNION ALL SELECT w, c, d FROM df) SELECT w, CAST(c AS INTEGER) AS c, round(x / sum(x) OVER (PARTITION BY w), 6) + 0.0 AS p FROM (SELECT w, c, power(2.0, -2 * beta * (d - min(d) OVER (PARTITION BY w))) AS x FROM al JOIN bt USING (w))", "big")
def _(s, d):
    """The memberships of both stages, surer for frequent words."""
    big, uni, model, _, fresh = _stage(s, d)
    both = multistage.next_stage("attach", model, big, uni, fresh, 2, 6, beta=3.0)
    return _rounded(both.membership(2.0, multistage.frequency_betas(uni)), "p")


_PARALLEL = f"""{_CLASSED}, pf AS (SELECT * FROM oc WHERE t IN (SELECT w FROM fr)), {_SHARES.format("pf")},
ps AS (SELECT row_number() OVER (ORDER BY f DESC, w) + 5 AS c, w FROM uni WHERE w IN (SELECT t FROM pfs) ORDER BY f DESC, w LIMIT 4), c1 AS (SELECT c, k, x FROM ps JOIN pfs ON t = w), {_FAR.format("d1", "pfs", "c1")},
a1 AS (SELECT w, c FROM (SELECT w, c, row_number() OVER (PARTITION BY w ORDER BY d, c) AS r FROM d1) WHERE r = 1),
c2 AS (SELECT a1.c AS c, k, sum(x) / any_value(n) AS x FROM pfs JOIN a1 ON a1.w = t JOIN (SELECT c, count(*) AS n FROM a1 GROUP BY c) USING (c) GROUP BY a1.c, k), {_FAR.format("d2", "pfs", "c2")},
a2 AS (SELECT w, c FROM (SELECT w, c, row_number() OVER (PARTITION BY w ORDER BY d, c) AS r FROM d2) WHERE r = 1)"""


@query("stage_parallel", _SOFT + _PARALLEL + " SELECT w, CAST(c AS INTEGER) AS c, 1 AS stage FROM ow UNION ALL SELECT w, CAST(c AS INTEGER), 2 FROM a2", "big")
def _(s, d):
    """200 words, and 200 more in four classes of their own, by two rounds of k-means."""
    big, uni, model, _, fresh = _stage(s, d)
    return multistage.next_stage("parallel", model, big, uni, fresh, 2, 4, rounds=2, beta=3.0).own


_SLOTS = """, tri AS (SELECT w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM tok WINDOW o AS (PARTITION BY doc_id, sid ORDER BY pos)),
top AS (SELECT DISTINCT w1, w2, w3 FROM tri WHERE w1 IN (SELECT w FROM ow) AND w2 IN (SELECT w FROM ow) AND w3 IN (SELECT w FROM ow)),
sl AS (SELECT 0 AS slot, w1, w2, w3, b, f FROM top JOIN sides ON t = w1 AND dir = 'right' UNION ALL SELECT 1, w1, w2, w3, b, f FROM top JOIN sides ON t = w2 AND dir = 'left'
UNION ALL SELECT 2, w1, w2, w3, b, f FROM top JOIN sides ON t = w2 AND dir = 'right' UNION ALL SELECT 3, w1, w2, w3, b, f FROM top JOIN sides ON t = w3 AND dir = 'left')"""


def _slots(s, d, hard):
    """(slot, w1, w2, w3, b, f): what stands in the slots is classed first, so that a trigram meets as many rows as classes, not all partners of its words."""
    big, _, model, soft = _soft(s, d)
    known = model.own.select("w")
    top = sents(s, d).where(F.size("toks") >= 3).select(F.explode(corpus.windows(F.col("toks"), 3)).alias("g")).select("g.*")
    for w in ("w1", "w2", "w3"):
        top = top.join(F.broadcast(known.withColumnRenamed("w", w)), w)
    shares = soft_classes.likeliest(soft).withColumn("p", F.lit(1.0)) if hard else soft
    classed = kept(multistage.over_classes(multistage.cells(big, known), shares), "cells")
    return profile_shapes.trigram_slots(classed, kept(top.select("w1", "w2", "w3").distinct(), "trigrams"), wide=True)


for _hard in (True, False):

    def _add_slots(hard: bool) -> None:
        known = "(SELECT w, c, 1.0::DOUBLE AS p FROM ow)" if hard else "me"

        @query("slots_hard" if hard else "slots_soft", _SOFT + _SLOTS + f", kn AS (SELECT w, '~' || c AS b, p FROM {known} UNION ALL SELECT '__$', '__$', 1.0) SELECT CAST(slot AS INTEGER) AS slot, w1, w2, w3, kn.b AS b, round(sum(f * p), 3) + 0.0 AS f FROM sl JOIN kn ON kn.w = sl.b GROUP BY ALL", "big")
        def _(s, d):
            """Trigram slots of the 200 words, what stands in them by class."""
            return _rounded(_slots(s, d, hard), "f", digits=3)

    _add_slots(_hard)


def _add_stages(kind: str) -> None:
    @query(f"{kind}_stages")
    def _(s, d):
        """All words in 20 classes of like neighbours: 200 words clustered, then 1,000, then all others."""
        uni, big = counted(s, d)
        model = multistage.staged(kind, big, uni, [200, 1_000, None], 100, 20, beta=3.0)
        return model.own.select("w", F.col("c").alias("cluster"), "stage")


for _name in multistage.KINDS:
    _add_stages(_name)
