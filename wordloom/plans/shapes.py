"""Queries over re-shaped profiles, staged classes, morphology, trees and tests of significance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.storage import kept, table
from ..operators import evaluation, language_model, morphology, profile_shapes, profiles, stages
from .associations import _PAIRS, _profile
from .registry import query
from .records import _points
from .text import _LEX, bigrams, counted, tagged, unigrams

_GT = _PAIRS.format("dense") + """, cc AS (SELECT dir, f AS r, count(*) AS nr FROM pr WHERE f > 0 GROUP BY dir, f),
gp AS (SELECT dir, r, nr, coalesce(lag(r) OVER o, 0) AS lo, lead(r) OVER o AS hi FROM cc WINDOW o AS (PARTITION BY dir ORDER BY r)), zz AS (SELECT dir, r, 2 * nr / (coalesce(hi, 2 * r - lo) - lo) AS z FROM gp)"""


def _rounded(df, digits: int = 4):
    return df.withColumn("value", F.round("value", digits) + F.lit(0.0))


@query("lr_good_turing", _GT + """, ln AS (SELECT dir, regr_slope(ln(z), ln(r)) AS e, regr_intercept(ln(z), ln(r)) AS a FROM zz GROUP BY dir),
sm AS (SELECT dir, sum(f) AS n, min(CASE WHEN f > 0 THEN f END) AS m, count(*) FILTER (WHERE f = 0) AS zeros FROM pr GROUP BY dir)
SELECT dir, t, b, round(CASE WHEN f > 0 THEN (f + m) * power((f + m) / f, e) ELSE exp(a + e * ln(m)) / sm.n / zeros END, 4) + 0.0 AS value FROM pr JOIN ln USING (dir) JOIN sm USING (dir)""", "big")
def _(s, d):
    return _rounded(profile_shapes.good_turing_profile(_profile(s, d, True)))


@query("lr_interpolated", _PAIRS.format("dense") + """, w AS (SELECT dir, sum(CASE WHEN (CASE WHEN fb > 1 THEN (f - 1) / (fb - 1) ELSE 0 END) > (CASE WHEN n > 1 THEN (ft - 1) / (n - 1) ELSE 0 END) THEN f ELSE 0 END) / sum(f) AS l2 FROM pr WHERE f > 0 GROUP BY dir)
SELECT dir, t, b, round(l2 * f + (1 - l2) * fb, 4) + 0.0 AS value FROM pr JOIN w USING (dir)""", "big")
def _(s, d):
    return _rounded(profile_shapes.interpolated_profile(_profile(s, d, True)))


@query("lr_frequency_entropy", _GT + """, ln AS (SELECT dir, regr_slope(ln(z), ln(r + 1)) AS e, regr_intercept(ln(z), ln(r + 1)) AS a FROM zz GROUP BY dir),
s AS (SELECT dir, a, e, sum(exp(a + e * ln(r + 1))) AS s FROM zz JOIN ln USING (dir) GROUP BY ALL)
SELECT dir, t, b, round(log2(s) - (a + e * ln(f + 1)) / ln(2.0), 4) + 0.0 AS value FROM pr JOIN s USING (dir)""", "big")
def _(s, d):
    return _rounded(profile_shapes.frequency_entropy(_profile(s, d, True)))


@query("lr_zipf", _PAIRS.format("ex") + """, lv AS (SELECT f, sum(count(*)) OVER (ORDER BY f DESC) - count(*) + (count(*) + 1) / 2.0 AS rank FROM big GROUP BY f),
l AS (SELECT regr_slope(ln(f + 1), ln(rank)) AS e, regr_intercept(ln(f + 1), ln(rank)) AS a FROM lv)
SELECT dir, t, b, round(a + e * ln(rank), 4) + 0.0 AS value FROM ex JOIN lv USING (f), l""", "big")
def _(s, d):
    uni, big = counted(s, d)
    pairs = profiles.extracted(big, kept(profiles.most_frequent(uni, 500), "targets"), kept(profiles.most_frequent(uni, 200), "bounds"))
    return _rounded(profile_shapes.zipf_fitted(pairs, big))


@query("lr_frequency_ranks", _PAIRS.format("dense") + " SELECT dir, t, b, rank() OVER (PARTITION BY dir ORDER BY f) + (count(*) OVER (PARTITION BY dir, f) - 1) / 2.0 - 1 AS value FROM pr", "big")
def _(s, d):
    return _rounded(profile_shapes.cell_ranks(_profile(s, d, True)))


for _name, _order in (("unique", "PARTITION BY dir ORDER BY f, t, b"), ("joint_unique", "ORDER BY f, dir, t, b")):

    def _add_unique(name: str, order: str) -> None:
        @query(f"lr_frequency_ranks_{name}", _PAIRS.format("dense") + f" SELECT dir, t, b, CAST(row_number() OVER ({order}) - 1 AS DOUBLE) AS value FROM pr", "big")
        def _(s, d):
            return profile_shapes.cell_ranks(_profile(s, d, True), shared=False, joint=name.startswith("joint"))

    _add_unique(_name, _order)


@query("lr_frequency_ranks_joint", _PAIRS.format("dense") + " SELECT dir, t, b, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0 - 1 AS value FROM pr", "big")
def _(s, d):
    return profile_shapes.cell_ranks(_profile(s, d, True), joint=True)


@query("lr_interpolated_targets", _PAIRS.format("dense") + """, w AS (SELECT dir, sum(CASE WHEN (CASE WHEN ft > 1 THEN (f - 1) / (ft - 1) ELSE 0 END) > (CASE WHEN n > 1 THEN (fb - 1) / (n - 1) ELSE 0 END) THEN f ELSE 0 END) / sum(f) AS l2 FROM pr WHERE f > 0 GROUP BY dir)
SELECT dir, t, b, round(l2 * f + (1 - l2) * ft, 4) + 0.0 AS value FROM pr JOIN w USING (dir)""", "big")
def _(s, d):
    return _rounded(profile_shapes.interpolated_profile(_profile(s, d, True), over="t"))


@query("lr_interpolated_all", _PAIRS.format("dense") + """, u1 AS (SELECT w1, sum(f) AS f1 FROM big GROUP BY w1), u2 AS (SELECT w2, sum(f) AS f2 FROM big GROUP BY w2), nn AS (SELECT sum(f) AS n FROM big),
w AS (SELECT sum(CASE WHEN (CASE WHEN f1 > 1 THEN (f - 1) / (f1 - 1) ELSE 0 END) > (CASE WHEN n > 1 THEN (f2 - 1) / (n - 1) ELSE 0 END) THEN f ELSE 0 END) / sum(f) AS l2 FROM big JOIN u1 USING (w1) JOIN u2 USING (w2), nn)
SELECT dir, t, b, round(l2 * f + (1 - l2) * fb, 4) + 0.0 AS value FROM pr, w""", "big")
def _(s, d):
    """By the weights of all bigrams, which are counted once for both."""
    uni, big = counted(s, d)
    dense = profiles.profile(big, kept(profiles.most_frequent(uni, 500), "targets"), kept(profiles.most_frequent(uni, 200), "bounds"), True)
    return _rounded(profile_shapes.interpolated_profile(dense, weights=language_model.interpolation_weights(big)))


@query("lr_weighted_sides", _PAIRS.format("ex") + """, mi AS (SELECT dir, t, sum(log2(f * nl / (ftl * fbl))) AS mi FROM pr GROUP BY dir, t), w AS (SELECT dir, t, CASE WHEN mi <> 0 THEN mi / sum(mi) OVER (PARTITION BY t) ELSE 0 END AS w FROM mi)
SELECT dir, t, b, round(f / nl * w, 7) + 0.0 AS value FROM pr JOIN w USING (dir, t)""", "big")
def _(s, d):
    return _rounded(profile_shapes.weighted_sides(_profile(s, d, False).select("dir", "t", "b", "f")), 7)


@query("lr_trigram_slots", _PAIRS.format("ex") + """, tri AS (SELECT w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM tok WINDOW o AS (PARTITION BY doc_id, sid ORDER BY pos)),
top AS (SELECT w1, w2, w3 FROM tri WHERE w3 IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, w1, w2, w3 LIMIT 200)
SELECT 0 AS slot, w1, w2, w3, b, f FROM top JOIN ex ON t = w1 AND dir = 'right' UNION ALL SELECT 1, w1, w2, w3, b, f FROM top JOIN ex ON t = w2 AND dir = 'left'
UNION ALL SELECT 2, w1, w2, w3, b, f FROM top JOIN ex ON t = w2 AND dir = 'right' UNION ALL SELECT 3, w1, w2, w3, b, f FROM top JOIN ex ON t = w3 AND dir = 'left'""", "big")
def _(s, d):
    from ..operators import corpus
    from .text import sents

    long = sents(s, d).where(F.size("toks") >= 3).select(F.explode(corpus.windows(F.col("toks"), 3)).alias("g")).select("g.*")
    top = kept(long.groupBy("w1", "w2", "w3").agg(F.count("*").alias("f")).orderBy(F.desc("f"), "w1", "w2", "w3").limit(200).drop("f"), "trigrams")
    uni, big = counted(s, d)
    pairs = profiles.extracted(big, kept(profiles.most_frequent(uni, 500), "targets"), kept(profiles.most_frequent(uni, 200), "bounds"))
    return profile_shapes.trigram_slots(kept(pairs, "pairs"), top)


# Classes: here the first letter of a word, so that SQL can follow.

def _classes(uni):
    return uni.select("w", F.substring("w", 1, 1).alias("c"), F.lit(1.0).alias("p"))


@query("class_emissions", " SELECT substr(w, 1, 1) AS c, w, CAST(f AS DOUBLE) AS f FROM uni", "tok")
def _(s, d):
    uni = kept(unigrams(s, d), "unigrams")
    return stages.emissions(_classes(uni), uni)


_TRANSITIONS = ", tr AS (SELECT substr(w1, 1, CASE WHEN w1 = '__$' THEN 3 ELSE 1 END) AS c1, substr(w2, 1, CASE WHEN w2 = '__$' THEN 3 ELSE 1 END) AS c2, CAST(sum(f) AS DOUBLE) AS f FROM big GROUP BY ALL)"


@query("class_transitions", _TRANSITIONS + " SELECT c1, c2, f FROM tr", "big")
def _(s, d):
    return stages.transitions(_classes(unigrams(s, d)), bigrams(s, d))


@query("class_labels", ", k AS (SELECT substr(w, 1, 1) AS c, w, row_number() OVER (PARTITION BY substr(w, 1, 1) ORDER BY f DESC, w) AS k FROM uni) SELECT c, c || '_' || string_agg(w, '_' ORDER BY k) AS label FROM k WHERE k <= 2 GROUP BY c", "tok")
def _(s, d):
    uni = kept(unigrams(s, d), "unigrams")
    return stages.class_labels(_classes(uni), uni)


@query("description_length", _TRANSITIONS + """, a AS (SELECT -sum(f * log2(f / n)) AS a FROM (SELECT f, sum(f) OVER (PARTITION BY c1) AS n FROM tr)), b AS (SELECT -sum(f * log2(f / n)) AS b FROM (SELECT f, sum(f) OVER (PARTITION BY substr(w, 1, 1)) AS n FROM uni))
SELECT round((SELECT count(*) * log2(count(DISTINCT substr(w, 1, 1))) FROM uni), 3) AS model, round(a + b, 1) AS corpus FROM a, b""", "big")
def _(s, d):
    uni = kept(unigrams(s, d), "unigrams")
    out = stages.description_length(_classes(uni), uni, stages.transitions(_classes(uni), bigrams(s, d)))
    return out.select(F.round("model", 3).alias("model"), F.round("corpus", 1).alias("corpus"))


@query("merged_classes")
def _(s, d):
    """The 40 most frequent words in ten classes, merged by mutual information over all bigrams."""
    uni, big = counted(s, d)
    words = [r["w"] for r in profiles.most_frequent(uni, 40).collect()]
    at = {w: i for i, w in enumerate(words)}
    c = np.zeros((len(words), len(words)))
    for r in big.where(F.col("w1").isin(words) & F.col("w2").isin(words)).collect():
        c[at[r["w1"]], at[r["w2"]]] += r["f"]
    return s.createDataFrame(list(zip(words, stages.merged_classes(c, 10), strict=True)), "w string, cluster int")


@query("svd_projection")
def _(s, d):
    """All vectors in the space of their eight largest singular values."""
    points = _points(s, d).drop("cluster")
    return stages.projected(points, stages.singular_vectors(points, 8)[1])


@query("induced_tags", _LEX.replace("w, lang AS tag", "substr(w, 1, 1) AS w, lang AS tag") + """, m AS (SELECT w, tag, f, sum(f) OVER () AS n, row_number() OVER (PARTITION BY w ORDER BY f DESC, tag) AS a, row_number() OVER (PARTITION BY tag ORDER BY f DESC, w) AS b FROM lex)
SELECT round(sum(CASE WHEN a = 1 THEN f ELSE 0 END) / max(n), 6) AS precision, round(sum(CASE WHEN b = 1 THEN f ELSE 0 END) / max(n), 6) AS recall, round(sum(CASE WHEN a = 1 AND b = 1 THEN f ELSE 0 END) / max(n), 6) AS mutual FROM m""", "tok")
def _(s, d):
    lex = tagged(s, d).groupBy(F.substring("w", 1, 1).alias("w"), "tag").agg(F.count("*").alias("f"))
    out = evaluation.induced_tags(kept(lex, "lexicon"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_PREFIXES, _SUFFIXES = ["re", "un", "in"], ["ing", "ed", "s", "ly", "tion"]
_FRONT = "in|re|un"


@query("stemmer", f""", h AS (SELECT w, rtrim(regexp_replace(w, '^((?:{_FRONT})*).*$', '\\1')) AS hd FROM uni), g AS (SELECT w, CASE WHEN length(hd) = length(w) AND hd <> '' THEN left(hd, length(hd) - 2) ELSE hd END AS hd FROM h)
SELECT w, length(hd) AS head FROM g""", "tok")
def _(s, d):
    parsed = morphology.stemmed(unigrams(s, d), _PREFIXES, [])
    return parsed.select("w", (F.length("w") - F.length(F.element_at(F.split("parse", r"\."), -1))).cast("long").alias("head"))


@query("stemmer_parses")
def _(s, d):
    """Every word cut into prefixes, stem and suffixes."""
    return morphology.stemmed(unigrams(s, d), _PREFIXES, _SUFFIXES)


_TREE = ", nodes AS (SELECT DISTINCT substr(w, 1, k) AS node, CASE WHEN k > 1 THEN substr(w, 1, k - 1) END AS parent FROM (SELECT w, unnest(range(1, length(w) + 1)) AS k FROM uni))"


def _tree(s, d):
    each = unigrams(s, d).select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("k"))
    return kept(each.select(F.expr("substring(w, 1, k)").alias("node"), F.when(F.col("k") > 1, F.expr("substring(w, 1, k - 1)")).alias("parent")).distinct(), "tree")


@query("tree_paths", _TREE.replace(", nodes", ", nodes", 1) + " SELECT node, substr(node, 1, 1) AS root, CAST(length(node) - 1 AS BIGINT) AS depth, array_to_string(list_transform(range(1, length(node) + 1), lambda k: substr(node, 1, k)), '/') AS path FROM nodes", "tok")
def _(s, d):
    return morphology.tree_paths(_tree(s, d))


@query("tree_leaves", _TREE + " SELECT node, parent FROM nodes ANTI JOIN (SELECT DISTINCT parent AS node FROM nodes) USING (node)", "tok")
def _(s, d):
    return morphology.leaves(_tree(s, d))


@query("t_test", """WITH m AS (SELECT event_type, avg(value) AS m, var_samp(value) / count(*) AS v FROM events GROUP BY event_type) SELECT a.event_type AS a, b.event_type AS b, round((a.m - b.m) / sqrt(a.v + b.v), 6) AS t FROM m a JOIN m b ON a.event_type < b.event_type""")
def _(s, d):
    m = table(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), (F.var_samp("value") / F.count("value")).alias("v"))
    a, b = m.select(*[F.col(c).alias(f"{c}_a") for c in m.columns]), m.select(*[F.col(c).alias(f"{c}_b") for c in m.columns])
    return a.join(F.broadcast(b), F.col("event_type_a") < F.col("event_type_b")).select(F.col("event_type_a").alias("a"), F.col("event_type_b").alias("b"), F.round((F.col("m_a") - F.col("m_b")) / F.sqrt(F.col("v_a") + F.col("v_b")), 6).alias("t"))


@query("roulette")
def _(s, d):
    """A weighted sample of 50 words without replacement, the same at each run: the largest ln(u) / f of hashed u."""
    u = (F.pmod(F.xxhash64("w", F.lit("seed")), F.lit(1 << 53)) + 1).cast("double") / float((1 << 53) + 1)
    return unigrams(s, d).orderBy(F.desc(F.log(u) / F.col("f")), "w").limit(50)
