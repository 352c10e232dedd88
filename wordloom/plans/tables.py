"""Queries over dictionaries of tuples, distributions with missing values, acceptors, groups and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.storage import kept, table
from ..operators import collection, corpus, dictionary, distribution, fitting, profile_shapes, profiles, trie
from .associations import _PAIRS, _profile
from .records import _KEY, _points, _records
from .registry import query
from .shapes import _GT, _classes, _rounded
from .text import bigrams, sents, toks, unigrams

# Dictionaries of tuples.

_IDS = """, v AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS id FROM (SELECT w1 AS w FROM big UNION SELECT w2 FROM big)),
p AS (SELECT w1, w2, f, row_number() OVER (ORDER BY w1, w2) - 1 AS id FROM big), q AS (SELECT w1, w2, f, p.id, a.id AS i, b.id AS j FROM p JOIN v a ON a.w = w1 JOIN v b ON b.w = w2)"""


@query("enum_nary", _IDS + " SELECT w1, w2, CAST(id AS BIGINT) AS id, CAST(i AS BIGINT) AS id_w1, CAST(j AS BIGINT) AS id_w2 FROM q", "big")
def _(s, d):
    return dictionary.nary(kept(bigrams(s, d), "bigrams"), ["w1", "w2"])


@query("enum_flat", _IDS + " SELECT w1, w2, CAST(i * n + j AS BIGINT) AS flat, CAST(i AS BIGINT) AS id_w1, CAST(j AS BIGINT) AS id_w2 FROM q, (SELECT count(*) AS n FROM v)", "big")
def _(s, d):
    """Tuples as one number each, and back."""
    big = kept(bigrams(s, d), "bigrams")
    ids = kept(dictionary.nary(big, ["w1", "w2"]), "ids")
    size = big.select("w1").union(big.select("w2")).distinct().count()
    return dictionary.unflat(dictionary.flat(ids, ["id_w1", "id_w2"], size).select("w1", "w2", "flat"), ["id_w1", "id_w2"], size)


@query("edist_ids", _IDS + " SELECT CAST(i AS BIGINT) AS id_w1, CAST(j AS BIGINT) AS id_w2, f FROM q", "big")
def _(s, d):
    """A distribution over ids."""
    big = kept(bigrams(s, d), "bigrams")
    return big.join(dictionary.nary(big, ["w1", "w2"]), ["w1", "w2"]).select("id_w1", "id_w2", "f")


@query("edist_symbols", "SELECT w1, w2, f FROM big", "big")
def _(s, d):
    """A distribution over ids, back in symbols."""
    big = kept(bigrams(s, d), "bigrams")
    ids = kept(dictionary.nary(big, ["w1", "w2"]), "ids")
    coded = big.join(ids, ["w1", "w2"]).select("id_w1", "id_w2", "f")
    names = kept(ids.select(F.col("id_w1").alias("id"), F.col("w1").alias("w")).union(ids.select("id_w2", "w2")).distinct(), "names")
    one = coded.join(names.select(F.col("id").alias("id_w1"), F.col("w").alias("w1")), "id_w1")
    return one.join(names.select(F.col("id").alias("id_w2"), F.col("w").alias("w2")), "id_w2").select("w1", "w2", "f")


@query("enum_vector", "SELECT l_partkey, l_suppkey, CAST(row_number() OVER (ORDER BY l_partkey, l_suppkey) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def _(s, d):
    found = dictionary.vectors(table(s, d, "lineitem").select(F.array("l_partkey", "l_suppkey").alias("v")), "v")
    return found.select(F.get("sym", 0).alias("l_partkey"), F.get("sym", 1).alias("l_suppkey"), "id")


@query("enum_recoded", "SELECT w, CAST(strlen(w) AS BIGINT) AS length FROM uni", "tok")
def _(s, d):
    """Words whose UTF-8 bytes are read as Latin-1: a character for each byte."""
    words = unigrams(s, d).select("w", F.col("w").alias("r"))
    return dictionary.recoded(words, "r", "UTF-8", "ISO-8859-1").select("w", F.length("r").cast("long").alias("length"))


@query("short_first", "SELECT w, CAST(row_number() OVER (ORDER BY length(w), w) AS BIGINT) AS place FROM uni", "tok")
def _(s, d):
    return dictionary.indexed(unigrams(s, d).select("w"), scalar.short_first(F.col("w")), "place", 1)


# Tables of cells.


@query("cells_transposed", "SELECT w2 AS w1, w1 AS w2, f FROM big", "big")
def _(s, d):
    return distribution.transposed(bigrams(s, d), "w1", "w2")


@query("cells_slice", "SELECT w2, f FROM big WHERE w1 = '__$'", "big")
def _(s, d):
    return distribution.sliced(bigrams(s, d), {"w1": corpus.EDGE})


@query("ngrams_sane", "SELECT w1 || chr(9) || w2 AS g, f FROM big", "big")
def _(s, d):
    return distribution.sane(distribution.expanded_prefixes(bigrams(s, d), 2), "g", 2).select("g", "f")


@query("ngrams_edges", """, p3 AS (SELECT doc_id, sid, list_concat(['__$'], toks, ['__$']) AS p FROM sents), t3 AS (SELECT doc_id, sid, unnest(p) AS w, generate_subscripts(p, 1) AS pos FROM p3),
g AS (SELECT w1, w2, w3, count(*) AS f FROM (SELECT w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM t3 WINDOW o AS (PARTITION BY doc_id, sid ORDER BY pos)) WHERE w3 IS NOT NULL GROUP BY ALL)
SELECT w1, w2, w3, CAST(sum(f) AS BIGINT) AS f FROM (SELECT * FROM g UNION ALL SELECT '__$', w1, w2, f FROM g WHERE w1 = '__$' UNION ALL SELECT w2, w3, '__$', f FROM g WHERE w3 = '__$') GROUP BY ALL""", "tok")
def _(s, d):
    """Trigrams between one edge mark on either side, expanded to what two marks would give."""
    p = corpus.padded("toks", 1, 1)
    grams = sents(s, d).select(F.explode(corpus.windows(p, 3)).alias("g")).select("g.*").where("w3 is not null").groupBy("w1", "w2", "w3").agg(F.count("*").alias("f"))
    return distribution.edge_expanded(grams, 3, corpus.EDGE)


@query("sparse_missing", """, n AS (SELECT CAST(count(DISTINCT w1) AS DOUBLE) * count(DISTINCT w2) AS cells, count(*) AS stored, sum(f) AS s, sum(f * log2(f)) AS l FROM big)
SELECT cells, CAST(stored AS BIGINT) AS stored, s + (cells - stored) * 0.5 AS total, round((s + (cells - stored) * 0.5) / cells, 9) AS mean, round(log2(s + (cells - stored) * 0.5) - (l + (cells - stored) * 0.5 * log2(0.5)) / (s + (cells - stored) * 0.5), 6) AS entropy FROM n""", "big")
def _(s, d):
    out = distribution.with_missing(kept(bigrams(s, d), "bigrams"), ["w1", "w2"], 0.5)
    return out.withColumn("mean", F.round("mean", 9)).withColumn("entropy", F.round("entropy", 6))


@query("moments", ", l AS (SELECT lang, w, count(*) AS f FROM tok GROUP BY ALL) SELECT lang, round(sum(f * length(w)) / sum(f), 6) AS expectation, round(sum(f * length(w) * length(w)) / sum(f) - power(sum(f * length(w)) / sum(f), 2), 6) AS variance FROM l GROUP BY lang", "tok")
def _(s, d):
    """Expectation and variance of the length of a word, by language."""
    out = distribution.moments(unigrams(s, d, "lang"), F.length("w"), "lang")
    return out.select("lang", F.round("expectation", 6).alias("expectation"), F.round("variance", 6).alias("variance"))


@query("row_entropy", ", n AS (SELECT w1, f, sum(f) OVER (PARTITION BY w1) AS n FROM big) SELECT w1, round(-sum(f / n * log2(f / n)), 6) + 0.0 AS h FROM n GROUP BY w1", "big")
def _(s, d):
    return distribution.entropy(bigrams(s, d), "w1").select("w1", (F.round("h", 6) + F.lit(0.0)).alias("h"))


@query("value_entropy", ", c AS (SELECT f AS r, count(*) AS nr FROM uni GROUP BY f), n AS (SELECT nr, sum(nr) OVER () AS n FROM c) SELECT round(-sum(nr / n * log2(nr / n)), 6) AS h FROM n", "tok")
def _(s, d):
    """The entropy of the counts of words as values."""
    return distribution.entropy(distribution.count_counts(unigrams(s, d)).withColumnRenamed("nr", "f")).select(F.round("h", 6).alias("h"))


@query("pointwise_entropy", "SELECT w, round(-log2(f / (SELECT sum(f) FROM uni)), 6) AS h, round(exp(ln(f / (SELECT sum(f) FROM uni))), 9) AS p FROM uni", "tok")
def _(s, d):
    """The bits of each word, and its probability as the weight of an arc and back."""
    u = distribution.normalized(unigrams(s, d))
    return u.select("w", F.round(-F.log2("p"), 6).alias("h"), F.round(scalar.as_probability(scalar.as_weight(F.col("p"))), 9).alias("p"))


@query("code_lengths", ", l AS (SELECT lang, w, count(*) AS f FROM tok GROUP BY ALL), n AS (SELECT lang, f, sum(f) OVER (PARTITION BY lang) AS n FROM l) SELECT lang, CAST(count(*) AS BIGINT) AS events, round(-sum(f * log2(f / n)), 3) AS message, round(log2(count(*)), 6) AS most, round(1.0 / count(*), 9) AS uniform FROM n GROUP BY lang", "tok")
def _(s, d):
    out = distribution.code_lengths(unigrams(s, d, "lang"), "lang")
    return out.select("lang", "events", F.round("message", 3).alias("message"), F.round("most", 6).alias("most"), F.round("uniform", 9).alias("uniform"))


# Profiles.


@query("lr_global_frequency_entropy", _PAIRS.format("dense") + """, cc AS (SELECT CAST(f AS DOUBLE) AS r, count(*) AS nr FROM big GROUP BY f), gp AS (SELECT r, nr, coalesce(lag(r) OVER (ORDER BY r), 0) AS lo, lead(r) OVER (ORDER BY r) AS hi FROM cc),
zz AS (SELECT r, 2 * nr / (coalesce(hi, 2 * r - lo) - lo) AS z FROM gp), ln AS (SELECT regr_slope(ln(z), ln(r + 1)) AS e, regr_intercept(ln(z), ln(r + 1)) AS a FROM zz)
SELECT dir, t, b, round(log2(n) - (a + e * ln(f + 1)) / ln(2.0), 4) + 0.0 AS value FROM pr, ln""", "big")
def _(s, d):
    return _rounded(profile_shapes.global_frequency_entropy(_profile(s, d, True), kept(bigrams(s, d), "bigrams")))


@query("lr_frequency_entropy_pointers", _GT + """, ln AS (SELECT dir, regr_slope(ln(z), ln(r + 1)) AS e, regr_intercept(ln(z), ln(r + 1)) AS a FROM zz GROUP BY dir),
s AS (SELECT dir, a, e, sum(exp(a + e * ln(r + 1))) AS s FROM zz JOIN ln USING (dir) GROUP BY ALL), h AS (SELECT *, log2(s) - (a + e * ln(f + 1)) / ln(2.0) AS h FROM pr JOIN s USING (dir))
SELECT dir, t, b, round(h + CASE WHEN h > 0 THEN -(log2(nzt / ft) + log2(nzb / fb)) / 2 ELSE 0 END, 4) + 0.0 AS value FROM h""", "big")
def _(s, d):
    return _rounded(profile_shapes.frequency_entropy_with_pointers(kept(_profile(s, d, True), "profile")))


for _total in ("ft", "fb"):

    def _add_total(total: str) -> None:
        @query(f"lr_over_{total}", _PAIRS.format("ex") + f" SELECT dir, t, b, f / {total} AS value FROM pr", "big")
        def _(s, d):
            return profile_shapes.over_totals(_profile(s, d, False), total)

    _add_total(_total)


@query("lr_remap_partners", ", m AS (SELECT w2 AS w, count(*) AS k FROM big WHERE w2 <> '__$' GROUP BY w2) SELECT substr(w, 1, 1) AS c, CAST(sum(k) AS DOUBLE) AS k FROM m GROUP BY 1", "big")
def _(s, d):
    """The different left neighbours of words, summed over the classes of their first letters."""
    partners = bigrams(s, d).where(F.col("w2") != corpus.EDGE).groupBy(F.col("w2").alias("w")).agg(F.count("*").alias("k"))
    return profile_shapes.remapped_partners(partners, _classes(unigrams(s, d).select("w")))


# Acceptors.

_ARCS = ", x AS (SELECT {0} AS w, f FROM uni), e AS (SELECT w, f, unnest(range(0, length(w) + 2)) AS k FROM x), a AS (SELECT CASE WHEN k = 0 THEN '' ELSE '__$' || substr(w, 1, k - 1) END AS source, CASE WHEN k = 0 OR k > length(w) THEN '__$' ELSE substr(w, k, 1) END AS label, f FROM e) SELECT source, label, source || label AS target, CAST(sum(f) AS BIGINT) AS f FROM a GROUP BY ALL"


@query("acceptor_prefixes", _ARCS.format("w"), "tok")
def _(s, d):
    return trie.acceptor(unigrams(s, d), corpus.EDGE)


@query("acceptor_suffixes", _ARCS.format("reverse(w)"), "tok")
def _(s, d):
    return trie.acceptor(unigrams(s, d), corpus.EDGE, reverse=True)


# Groups.


@query("coll_flatten", f"SELECT o_orderstatus || '/' || o_orderpriority AS path, {_KEY} AS key FROM orders")
def _(s, d):
    return collection.flattened(_records(s, d), ["status", "priority"])


@query("coll_paths", """SELECT 1 AS depth, o_orderstatus AS path, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS children FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 2, o_orderstatus || '/' || o_orderpriority, CAST(count(*) AS BIGINT), 0 FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def _(s, d):
    return collection.path_counts(_records(s, d), ["status", "priority"])


@query("coll_upsert", "SELECT o_custkey AS k, 'order' AS origin FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(s, d):
    known = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("origin")).distinct()
    return collection.upserted(known, table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin")), "k")


@query("coll_remove_some", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(s, d):
    large = table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return collection.removed(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), large, "o_orderkey")


# Fits and tests.


@query("order_medians", """WITH r AS (SELECT o_totalprice AS x, o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER () AS n FROM orders WHERE o_totalprice IS NOT NULL)
SELECT x, o_orderkey, round(CASE WHEN k = n THEN power(0.5, 1.0 / n) WHEN k = 1 THEN 1 - power(0.5, 1.0 / n) ELSE (k - 0.3175) / (n + 0.365) END, 9) AS m FROM r""")
def _(s, d):
    return fitting.order_medians(table(s, d, "orders").withColumnRenamed("o_totalprice", "x"), "x", "o_orderkey").withColumn("m", F.round("m", 9))


@query("qq_fit", """WITH r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER () AS n FROM orders WHERE o_totalprice IS NOT NULL),
m AS (SELECT x, CASE WHEN k = n THEN power(0.5, 1.0 / n) WHEN k = 1 THEN 1 - power(0.5, 1.0 / n) ELSE (k - 0.3175) / (n + 0.365) END AS m FROM r) SELECT round(regr_slope(x, m), 2) AS slope, round(regr_intercept(x, m), 2) AS intercept FROM m""")
def _(s, d):
    """A line through sorted prices over the medians of uniform places."""
    m = fitting.order_medians(table(s, d, "orders").withColumnRenamed("o_totalprice", "x"), "x", "o_orderkey")
    return fitting.line(m, F.col("m"), F.col("x")).select(F.round("slope", 2).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("rank_sums", """WITH r AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), s AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS w, max(n) AS a FROM r GROUP BY event_type)
SELECT event_type, n, w, w - n * (n + 1) / 2 AS u, round((w - n * (n + 1) / 2 - n * (a - n) / 2) / sqrt(n * (a - n) * (a + 1) / 12), 6) AS z FROM s""")
def _(s, d):
    return fitting.rank_sums(table(s, d, "events"), "event_type", "value").withColumn("z", F.round("z", 6))


@query("covariance_matrix", "WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(avg(a.x * b.x) - avg(a.x) * avg(b.x), 7) + 0.0 AS covariance FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i")
def _(s, d):
    return fitting.covariances(_points(s, d)).withColumn("covariance", F.round("covariance", 7) + F.lit(0.0))


@query("series_filtered", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, list_reverse(CAST(embedding AS DOUBLE[])) AS r FROM embeddings),
k AS (SELECT id, v, r, unnest(range(1, len(v) + 1)) AS k FROM v),
s AS (SELECT id, k, len(v) AS n, power(0.7, k - 1) * v[1] + coalesce(list_sum(list_transform(range(2, k + 1), lambda i: 0.3 * power(0.7, k - i) * v[i])), 0) AS a, power(0.7, k - 1) * r[1] + coalesce(list_sum(list_transform(range(2, k + 1), lambda i: 0.3 * power(0.7, k - i) * r[i])), 0) AS b FROM k)
SELECT x.id, CAST(x.k - 1 AS INTEGER) AS pos, round((x.a + y.b) / 2, 6) + 0.0 AS value FROM s x JOIN s y ON x.id = y.id AND y.k = x.n + 1 - x.k""")
def _(s, d):
    """Vectors as series, smoothed exponentially from both ends."""
    out = _points(s, d).select("id", F.posexplode(scalar.filtered(F.col("v"), 0.3)).alias("pos", "value"))
    return out.withColumn("value", F.round("value", 6) + F.lit(0.0))
