"""Queries over the words of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.storage import kept, table
from ..operators import corpus, dictionary, distribution, evaluation, fitting, hmm_tables, language_model, profiles, trie
from .registry import query


def sents(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sentences(table(spark, d, "documents"))


def toks(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tokens(sents(spark, d))


def unigrams(spark: SparkSession, d: str, *by: str) -> DataFrame:
    return toks(spark, d).groupBy(*by, "w").agg(F.count("*").alias("f"))


def bigrams(spark: SparkSession, d: str) -> DataFrame:
    return corpus.ngram_counts(sents(spark, d), 2)


def counted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(words (w, f), bigrams (w1, w2, f)), stored: one pass over the documents, as a word's count is that of the bigrams that it ends."""
    big = kept(bigrams(spark, d), "bigrams")
    ended = big.where(F.col("w2") != corpus.EDGE).groupBy(F.col("w2").alias("w")).agg(F.sum("f").alias("f"))
    return kept(ended, "unigrams"), big


def tagged(spark: SparkSession, d: str) -> DataFrame:
    return toks(spark, d).withColumn("tag", F.col("lang"))


@query("ugram", "SELECT w, f FROM uni", "tok")
def _(s, d):
    return unigrams(s, d)


@query("bgram", "SELECT w1, w2, f FROM big", "big")
def _(s, d):
    return bigrams(s, d)


@query("tgram", """, p3 AS (SELECT doc_id, sid, list_concat(['__$', '__$'], toks, ['__$', '__$']) AS p FROM sents),
t3 AS (SELECT doc_id, sid, unnest(p) AS w, generate_subscripts(p, 1) AS pos FROM p3)
SELECT w1, w2, w3, CAST(count(*) AS BIGINT) AS f FROM (SELECT w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM t3 WINDOW o AS (PARTITION BY doc_id, sid ORDER BY pos)) WHERE w3 IS NOT NULL GROUP BY ALL""", "tok")
def _(s, d):
    return corpus.ngram_counts(sents(s, d), 3)


@query("tgram_tag", """, p3 AS (SELECT doc_id, lang, sid, list_concat(['__$', '__$'], toks, ['__$']) AS p FROM sents),
t3 AS (SELECT doc_id, lang, sid, unnest(p) AS w, generate_subscripts(p, 1) AS pos FROM p3)
SELECT w1, w2, w3, lang AS tag, CAST(count(*) AS BIGINT) AS f FROM (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM t3 WINDOW o AS (PARTITION BY doc_id, sid ORDER BY pos)) WHERE w3 IS NOT NULL GROUP BY ALL""", "tok")
def _(s, d):
    p = corpus.padded("toks", 2, 1)
    return sents(s, d).select("lang", F.explode(corpus.windows(p, 3)).alias("g")).groupBy("g.w1", "g.w2", "g.w3", F.col("lang").alias("tag")).agg(F.count("*").alias("f"))


@query("vocabulary", "SELECT CAST(count(*) AS BIGINT) AS v, CAST(count(*) AS DOUBLE) * count(*) AS v2, CAST(count(*) AS DOUBLE) * count(*) * count(*) AS v3 FROM uni", "tok")
def _(s, d):
    v = F.count("*")
    return unigrams(s, d).agg(v.alias("v"), (v.cast("double") * v).alias("v2"), (v.cast("double") * v * v).alias("v3"))


@query("ngram_expand", "SELECT CAST(1 AS BIGINT) AS k, w1 AS g, CAST(sum(f) AS BIGINT) AS f FROM big GROUP BY w1 UNION ALL SELECT 2, w1 || chr(9) || w2, f FROM big", "big")
def _(s, d):
    return distribution.expanded_prefixes(bigrams(s, d), 2)


@query("positional", """, pairs AS (SELECT CAST(j AS BIGINT) AS step, a.w, b.w AS c FROM tok a JOIN (SELECT unnest([1, 2, 3]) AS j) ON true JOIN tok b ON a.doc_id = b.doc_id AND a.sid = b.sid AND b.pos = a.pos + j)
SELECT step, w, c, CAST(count(*) AS BIGINT) AS f FROM pairs GROUP BY ALL""", "tok")
def _(s, d):
    return corpus.positional_counts(sents(s, d), 3)


_TOPS = """, targets AS (SELECT w FROM uni ORDER BY f DESC, w LIMIT 500), bounds AS (SELECT w FROM uni ORDER BY f DESC, w LIMIT 200)"""


def _tops(s, d):
    uni = kept(unigrams(s, d), "unigrams")
    return kept(profiles.most_frequent(uni, 500), "targets"), kept(profiles.most_frequent(uni, 200), "bounds")


@query("lr_activation", _TOPS + """, p3 AS (SELECT doc_id, sid, list_concat(['__$', '__$', '__$'], toks, ['__$', '__$', '__$']) AS p FROM sents),
t3 AS (SELECT doc_id, sid, unnest(p) AS w, generate_subscripts(p, 1) AS pos FROM p3),
x AS (SELECT CASE WHEN j < 0 THEN 'left' ELSE 'right' END AS dir, a.w AS t, b.w AS b, power(abs(j), -0.5) AS z
 FROM t3 a SEMI JOIN targets ON a.w = targets.w JOIN (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS j) ON true JOIN t3 b ON a.doc_id = b.doc_id AND a.sid = b.sid AND b.pos = a.pos + j WHERE b.w IN (SELECT w FROM bounds))
SELECT dir, t, b, round(sum(z), 4) AS f FROM x GROUP BY ALL""", "tok")
def _(s, d):
    targets, bounds = _tops(s, d)
    return corpus.activation(sents(s, d), targets, bounds, 3, 0.5).withColumn("f", F.round("f", 4))


@query("lr_bound", _TOPS + """, pt AS (SELECT doc_id, sid, list_concat(['__$'], toks, ['__$']) AS p FROM sents),
t1 AS (SELECT doc_id, sid, unnest(p) AS w, generate_subscripts(p, 1) AS pos FROM pt),
m AS (SELECT *, CASE WHEN w = '__$' OR w IN (SELECT w FROM bounds) THEN w END AS b FROM t1),
n AS (SELECT w, last_value(b IGNORE NULLS) OVER (PARTITION BY doc_id, sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, first_value(b IGNORE NULLS) OVER (PARTITION BY doc_id, sid ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM m)
SELECT 'left' AS dir, w AS t, l AS b, CAST(count(*) AS BIGINT) AS f FROM n WHERE w <> '__$' GROUP BY ALL UNION ALL SELECT 'right', w, r, CAST(count(*) AS BIGINT) FROM n WHERE w <> '__$' GROUP BY ALL""", "tok")
def _(s, d):
    return corpus.nearest_bounds(sents(s, d).select("doc_id", "sid", "toks"), _tops(s, d)[1])


# Dictionaries.


@query("enum_ids", "SELECT w AS sym, CAST(row_number() OVER (ORDER BY w) - 1 AS BIGINT) AS id FROM uni", "tok")
def _(s, d):
    return dictionary.dictionary(unigrams(s, d), "w")


def _enum(s, d, lang):
    return dictionary.dictionary(toks(s, d).where(F.col("lang") == lang).select("w").distinct(), "w")


_ENUMS = """, en AS (SELECT w AS sym, row_number() OVER (ORDER BY w) - 1 AS id FROM (SELECT DISTINCT w FROM tok WHERE lang = 'en')),
de AS (SELECT w AS sym, row_number() OVER (ORDER BY w) - 1 AS id FROM (SELECT DISTINCT w FROM tok WHERE lang = 'de'))"""


@query("xlate_join", _ENUMS + " SELECT en.sym, CAST(en.id AS BIGINT) AS id, CAST(coalesce(de.id, (SELECT count(*) + 1 FROM de)) AS BIGINT) AS other_id FROM en LEFT JOIN de USING (sym)", "tok")
def _(s, d):
    return dictionary.translated(_enum(s, d, "en"), _enum(s, d, "de"))


@query("enum_union", ", e AS (SELECT DISTINCT w FROM tok WHERE lang IN ('en', 'de')) SELECT w AS sym, CAST(row_number() OVER (ORDER BY w) - 1 AS BIGINT) AS id FROM e", "tok")
def _(s, d):
    return dictionary.united(_enum(s, d, "en"), _enum(s, d, "de"))


@query("enum_anti", _ENUMS + " SELECT sym, CAST(id AS BIGINT) AS id FROM en WHERE sym NOT IN (SELECT sym FROM de)", "tok")
def _(s, d):
    return dictionary.without(_enum(s, d, "en"), _enum(s, d, "de"))


@query("enum_compact", _ENUMS + ", l AS (SELECT * FROM en WHERE sym NOT IN (SELECT sym FROM de)) SELECT sym, CAST(id AS BIGINT) AS old_id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS id FROM l", "tok")
def _(s, d):
    return dictionary.compacted(dictionary.without(_enum(s, d, "en"), _enum(s, d, "de")))


# Filters.


@query("byenum_semi", _TOPS + " SELECT w, CAST(count(*) AS BIGINT) AS f FROM tok WHERE w IN (SELECT w FROM bounds) GROUP BY w", "tok")
def _(s, d):
    return corpus.keep_known(toks(s, d), _tops(s, d)[1]).groupBy("w").agg(F.count("*").alias("f"))


@query("byenum_trigram", """, seen AS (SELECT lang, coalesce(lag(w, 2) OVER o, '__$') AS w1, coalesce(lag(w, 1) OVER o, '__$') AS w2, w AS w3 FROM tok WINDOW o AS (PARTITION BY doc_id, sid ORDER BY pos)),
en AS (SELECT DISTINCT w1, w2, w3 FROM seen WHERE lang = 'en') SELECT lang, CAST(count(*) AS BIGINT) AS n FROM seen SEMI JOIN en USING (w1, w2, w3) GROUP BY lang""", "tok")
def _(s, d):
    t = toks(s, d)
    order = Window.partitionBy("doc_id", "sid").orderBy("pos")
    known = t.where("lang = 'en'").select(F.coalesce(F.lag("w", 2).over(order), F.lit(corpus.EDGE)).alias("w1"), F.coalesce(F.lag("w", 1).over(order), F.lit(corpus.EDGE)).alias("w2"), F.col("w").alias("w3")).distinct()
    return corpus.keep_known_trigrams(t, known, ["doc_id", "sid"]).groupBy("lang").agg(F.count("*").alias("n"))


@query("safe_tags", "SELECT doc_id, CAST(sid AS BIGINT) AS sid, CAST(len(toks) AS BIGINT) AS n FROM sents WHERE NOT list_contains(toks, 'the') AND NOT list_contains(toks, 'de')", "tok")
def _(s, d):
    return corpus.safe_sentences(sents(s, d), "toks", ("the", "de")).select("doc_id", "sid", F.size("toks").cast("long").alias("n"))


@query("map_filter", _TOPS + " SELECT coalesce(upper(b.w), '@UNKNOWN') AS m, CAST(count(*) AS BIGINT) AS f FROM tok LEFT JOIN bounds b ON tok.w = b.w GROUP BY m", "tok")
def _(s, d):
    mapping = _tops(s, d)[1].select(F.col("w").alias("k"), F.upper("w").alias("v"))
    return corpus.mapped(toks(s, d), mapping, "w", "m").groupBy("m").agg(F.count("*").alias("f"))


@query("as_tagged", "SELECT doc_id, CAST(sid AS BIGINT) AS sid, array_to_string(list_transform(toks, lambda x: x || '/' || lang), ' ') AS line FROM sents", "tok")
def _(s, d):
    return corpus.as_tagged(sents(s, d)).select("doc_id", "sid", "line")


# Distributions.


@query("prune_value", "SELECT w, f FROM uni WHERE f BETWEEN 5 AND 50", "tok")
def _(s, d):
    return distribution.by_value(unigrams(s, d), 5, 50)


@query("prune_regex", "SELECT w, f FROM uni WHERE regexp_matches(w, '^th.*n$')", "tok")
def _(s, d):
    return unigrams(s, d).where(F.col("w").rlike("^th.*n$"))


@query("prune_rank", "SELECT w, f FROM (SELECT *, row_number() OVER (ORDER BY f DESC, w) AS k FROM uni) WHERE k BETWEEN 11 AND 300", "tok")
def _(s, d):
    return distribution.by_rank(unigrams(s, d), 11, 300, False)


@query("prune_rank_shared", "SELECT w, f FROM (SELECT *, dense_rank() OVER (ORDER BY f DESC) AS k FROM uni) WHERE k BETWEEN 3 AND 40", "tok")
def _(s, d):
    return distribution.by_rank(unigrams(s, d), 3, 40, True)


@query("prune_bash", "SELECT CASE WHEN f >= 10 THEN w ELSE '@UNKNOWN' END AS w, CAST(sum(f) AS BIGINT) AS f FROM uni GROUP BY 1", "tok")
def _(s, d):
    return distribution.folded(unigrams(s, d), F.col("f") >= 10)


@query("count_counts", "SELECT f AS r, CAST(count(*) AS BIGINT) AS nr FROM uni GROUP BY f", "tok")
def _(s, d):
    return distribution.count_counts(unigrams(s, d))


@query("normalize", "SELECT w, f, round(f / (SELECT sum(f) FROM uni), 9) AS p FROM uni", "tok")
def _(s, d):
    return distribution.normalized(unigrams(s, d)).withColumn("p", F.round("p", 9))


@query("conditionalize", "SELECT w1, w2, f, round(f / sum(f) OVER (PARTITION BY w1), 9) AS p FROM big", "big")
def _(s, d):
    return distribution.normalized(bigrams(s, d), "w1").withColumn("p", F.round("p", 9))


@query("marginal", "SELECT w2, CAST(sum(f) AS BIGINT) AS f FROM big GROUP BY w2", "big")
def _(s, d):
    return distribution.marginal(bigrams(s, d), "w2")


@query("total_mean", "SELECT CAST(sum(f) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS size, round(sum(f) / count(*), 6) AS mean FROM uni", "tok")
def _(s, d):
    return unigrams(s, d).agg(F.sum("f").alias("total"), F.count("*").alias("size"), F.round(F.sum("f") / F.count("*"), 6).alias("mean"))


@query("nonzero_cells", "SELECT CAST(count(*) AS BIGINT) AS nonzero, CAST(count(DISTINCT w1) AS DOUBLE) * count(DISTINCT w2) - count(*) AS zero FROM big", "big")
def _(s, d):
    return bigrams(s, d).agg(F.count("*").alias("nonzero"), (F.count_distinct("w1").cast("double") * F.count_distinct("w2") - F.count("*")).alias("zero"))


@query("add_dists", ", l AS (SELECT w, lang, count(*) AS f FROM tok WHERE lang IN ('en', 'fr') GROUP BY ALL) SELECT w, CAST(sum(f) AS BIGINT) AS f FROM l GROUP BY w", "tok")
def _(s, d):
    uni = kept(unigrams(s, d, "lang"), "by_lang")
    return distribution.added(*[uni.where(F.col("lang") == x).select("w", "f") for x in ("en", "fr")])


_H = "round(-sum(f / n * log2(f / n)), 6)"


@query("entropy", f", t AS (SELECT lang, w, count(*) AS f FROM tok GROUP BY ALL), u AS (SELECT *, sum(f) OVER (PARTITION BY lang) AS n FROM t) SELECT lang, {_H} AS h, round(power(2, -sum(f / n * log2(f / n))), 3) AS perplexity FROM u GROUP BY lang", "tok")
def _(s, d):
    return distribution.entropy(unigrams(s, d, "lang"), "lang").select("lang", F.round("h", 6).alias("h"), F.round(F.pow(F.lit(2.0), "h"), 3).alias("perplexity"))


@query("cond_entropy", f", n AS (SELECT *, sum(f) OVER () AS n FROM big), m AS (SELECT w1, sum(f) AS f, max(n) AS n FROM n GROUP BY w1) SELECT round((SELECT -sum(f / n * log2(f / n)) FROM n) - (SELECT -sum(f / n * log2(f / n)) FROM m), 6) AS h", "big")
def _(s, d):
    b = kept(bigrams(s, d), "bigrams")
    whole, first = distribution.entropy(b), distribution.entropy(distribution.marginal(b, "w1")).withColumnRenamed("h", "h1")
    return whole.crossJoin(first).select(F.round(F.col("h") - F.col("h1"), 6).alias("h"))


@query("mutual_info", ", n AS (SELECT f, sum(f) OVER () AS n, sum(f) OVER (PARTITION BY w1) AS a, sum(f) OVER (PARTITION BY w2) AS b FROM big) SELECT round(sum(f / n * log2(f * n / (a * b))), 6) AS mi FROM n", "big")
def _(s, d):
    return distribution.mutual_information(kept(bigrams(s, d), "bigrams"), "w1", "w2").select(F.round("mi", 6).alias("mi"))


@query("kl_lang", """, l AS (SELECT lang, w, count(*) AS f FROM tok GROUP BY ALL), p AS (SELECT lang, w, f / sum(f) OVER (PARTITION BY lang) AS p FROM l),
m AS (SELECT a.p AS pa, b.p AS pb FROM (SELECT * FROM p WHERE lang = 'en') a FULL JOIN (SELECT * FROM p WHERE lang = 'de') b ON a.w = b.w)
SELECT round(sum(pa * log2(pa / pb)), 6) AS kl, CAST(count(pa * pb) AS BIGINT) AS common, CAST(max(CASE WHEN pa IS NULL OR pb IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS differ FROM m""", "tok")
def _(s, d):
    uni = kept(unigrams(s, d, "lang"), "by_lang")
    p, q = (uni.where(F.col("lang") == x).select("w", "f") for x in ("en", "de"))
    return distribution.divergence(p, q).withColumn("kl", F.round("kl", 6))


@query("rank_unique", "SELECT w, f, CAST(row_number() OVER (ORDER BY f DESC, w) AS BIGINT) AS rank FROM uni", "tok")
def _(s, d):
    return distribution.unique_ranks(unigrams(s, d))


@query("rank_dense", "SELECT w, f, CAST(dense_rank() OVER (ORDER BY f DESC) AS BIGINT) AS rank FROM uni", "tok")
def _(s, d):
    return distribution.shared_ranks(kept(unigrams(s, d), "unigrams"))


@query("rank_avg", "SELECT w, f, rank() OVER (ORDER BY f DESC) + (count(*) OVER (PARTITION BY f) - 1) / 2.0 - 1 AS rank FROM uni", "tok")
def _(s, d):
    return distribution.average_ranks(kept(unigrams(s, d), "unigrams"))


@query("quanta", ", r AS (SELECT w, f, CAST(dense_rank() OVER (ORDER BY f DESC) AS BIGINT) AS rank FROM uni) SELECT w, f, rank, CAST(floor((1 + max(rank) OVER () - rank) / max(rank) OVER () * 10 + 0.5) AS BIGINT) AS quantum FROM r", "tok")
def _(s, d):
    return distribution.quanta(kept(distribution.shared_ranks(kept(unigrams(s, d), "unigrams")), "ranks"), 10)


_SMEAR = """, c AS (SELECT f AS r, count(*) AS nr FROM uni GROUP BY f), g AS (SELECT r, nr, coalesce(lag(r) OVER (ORDER BY r), 0) AS lo, lead(r) OVER (ORDER BY r) AS hi FROM c),
z AS (SELECT r, nr, 2.0 * nr / (coalesce(hi, 2 * r - lo) - lo) AS z FROM g)"""


@query("smear", _SMEAR + " SELECT r, CAST(nr AS BIGINT) AS nr, round(CAST(z AS DOUBLE), 6) AS z FROM z", "tok")
def _(s, d):
    return distribution.smeared(distribution.count_counts(unigrams(s, d))).withColumn("z", F.round("z", 6))


@query("gt_loglin", _SMEAR + ", l AS (SELECT regr_slope(ln(z), ln(r)) AS b FROM z) SELECT r, CAST(nr AS BIGINT) AS nr, round((r + 1) * exp(b * (ln(r + 1) - ln(r))), 4) AS r_star FROM z, l", "tok")
def _(s, d):
    return distribution.good_turing(unigrams(s, d)).withColumn("r_star", F.round("r_star", 4))


@query("missing_mass", "SELECT round(sum(CASE WHEN f = 1 THEN 1 ELSE 0 END) / sum(f), 9) AS mass FROM uni", "tok")
def _(s, d):
    return distribution.missing_mass(unigrams(s, d)).select(F.round("mass", 9).alias("mass"))


@query("power_law", ", c AS (SELECT f AS r, count(*) AS nr FROM uni GROUP BY f) SELECT round(regr_slope(ln(nr), ln(r)), 6) AS slope, round(regr_intercept(ln(nr), ln(r)), 6) AS intercept FROM c", "tok")
def _(s, d):
    return fitting.power_law(distribution.count_counts(unigrams(s, d)), "r", "nr").select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("zipf_fit", ", r AS (SELECT f, row_number() OVER (ORDER BY f DESC, w) AS k FROM uni) SELECT round(sum(f / k) / sum(1.0 / k / k), 3) AS c FROM r", "tok")
def _(s, d):
    return fitting.zipf_constant(distribution.unique_ranks(unigrams(s, d))).select(F.round("c", 3).alias("c"))


@query("log_bins", ", c AS (SELECT f AS r, count(*) AS nr FROM uni GROUP BY f) SELECT CAST(floor(ln(r) / ln(2.0) + 1e-9) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(nr), 5) AS mean, round(stddev_pop(nr), 5) AS deviation FROM c GROUP BY 1", "tok")
def _(s, d):
    return fitting.log_bins(distribution.count_counts(unigrams(s, d)), "r", "nr").select("bin", "n", F.round("mean", 5).alias("mean"), F.round("deviation", 5).alias("deviation"))


# Language models.


@query("score_unigram", """, m AS (SELECT w, f / sum(f) OVER () AS p FROM (SELECT w, count(*) AS f FROM tok WHERE lang = 'en' GROUP BY w))
SELECT doc_id, CAST(sid AS BIGINT) AS sid, round(sum(ln(coalesce(p, 1e-3))), 4) AS logp FROM tok LEFT JOIN m USING (w) GROUP BY ALL""", "tok")
def _(s, d):
    model = distribution.normalized(toks(s, d).where("lang = 'en'").groupBy("w").agg(F.count("*").alias("f")))
    return language_model.unigram_scores(toks(s, d), model, ["doc_id", "sid"]).withColumn("logp", F.round("logp", 4))


_BIGRAM_MODEL = """, b2 AS (SELECT doc_id, sid, w AS w1, lead(w) OVER (PARTITION BY doc_id, sid ORDER BY pos) AS w2 FROM ptok),
m AS (SELECT w1, w2, f / sum(f) OVER (PARTITION BY w1) AS p FROM big)"""


@query("score_bigram", _BIGRAM_MODEL + " SELECT doc_id, CAST(sid AS BIGINT) AS sid, round(sum(ln(coalesce(p, 1e-5))), 4) AS logp FROM b2 LEFT JOIN m USING (w1, w2) WHERE w2 IS NOT NULL GROUP BY ALL", "big")
def _(s, d):
    model = distribution.normalized(bigrams(s, d), "w1")
    return language_model.bigram_scores(sents(s, d), model, ["doc_id", "sid"]).withColumn("logp", F.round("logp", 4))


@query("corpus_info", """, m AS (SELECT w, f / sum(f) OVER () AS p FROM uni), s AS (SELECT doc_id, sid, sum(ln(p)) AS logp FROM tok JOIN m USING (w) GROUP BY ALL), x AS (SELECT max(logp) AS x FROM s)
SELECT round(sum(logp), 2) AS sum_logp, round(max(x) + ln(sum(exp(logp - x))), 5) AS log_sum_p, CAST(count(*) AS BIGINT) AS sentences, (SELECT CAST(count(*) AS BIGINT) FROM tok) AS tokens, round(-sum(logp) / ln(2.0) / (SELECT count(*) FROM tok), 6) AS entropy FROM s, x""", "tok")
def _(s, d):
    model = distribution.normalized(unigrams(s, d))
    scores = kept(language_model.unigram_scores(toks(s, d), model, ["doc_id", "sid"]), "scores")
    out = language_model.corpus_information(scores, toks(s, d))
    return out.select(F.round("sum_logp", 2).alias("sum_logp"), F.round("log_sum_p", 5).alias("log_sum_p"), "sentences", "tokens", F.round("entropy", 6).alias("entropy"))


@query("interpolation", """, x AS (SELECT f, sum(f) OVER (PARTITION BY w1) AS f1, sum(f) OVER (PARTITION BY w2) AS f2, sum(f) OVER () AS n FROM big),
y AS (SELECT f, CASE WHEN f1 > 1 THEN (f - 1) / (f1 - 1) ELSE 0 END AS c, CASE WHEN n > 1 THEN (f2 - 1) / (n - 1) ELSE 0 END AS p FROM x)
SELECT round(sum(CASE WHEN p >= c THEN f ELSE 0 END) / sum(f), 9) AS l1, round(sum(CASE WHEN c > p THEN f ELSE 0 END) / sum(f), 9) AS l2 FROM y""", "big")
def _(s, d):
    return language_model.interpolation_weights(kept(bigrams(s, d), "bigrams")).select(F.round("l1", 9).alias("l1"), F.round("l2", 9).alias("l2"))


# Lexica and evaluation; the language of a document is the tag of its words.

_LEX = ", lex AS (SELECT w, lang AS tag, CAST(count(*) AS BIGINT) AS f FROM tok GROUP BY ALL)"


@query("lexicon", "SELECT w, lang AS tag, CAST(count(*) AS BIGINT) AS f FROM tok GROUP BY ROLLUP (w, lang)", "tok")
def _(s, d):
    return evaluation.lexicon(tagged(s, d))


@query("lex_argmax", _LEX + " SELECT w, tag FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY f DESC, tag) AS k FROM lex) WHERE k = 1", "tok")
def _(s, d):
    return evaluation.best_tags(tagged(s, d).groupBy("w", "tag").agg(F.count("*").alias("f")))


@query("suplex_eval", """, lex AS (SELECT w, lang AS tag, count(*) AS f FROM tok GROUP BY ALL), best AS (SELECT w, tag FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY f DESC, tag) AS k FROM lex) WHERE k = 1)
SELECT CAST(count(*) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE best.tag IS NULL) AS BIGINT) AS unknown, CAST(count(*) FILTER (WHERE best.tag = lang) AS BIGINT) AS "right" FROM tok LEFT JOIN best USING (w)""", "tok")
def _(s, d):
    t = tagged(s, d)
    best = evaluation.best_tags(t.groupBy("w", "tag").agg(F.count("*").alias("f")))
    return evaluation.lexicon_accuracy(t, best)


@query("suplex_info", _LEX + """, n AS (SELECT *, sum(f) OVER () AS n FROM lex), e AS (SELECT -sum(f / n * log2(f / n)) AS h FROM n),
ew AS (SELECT -sum(f / n * log2(f / n)) AS h FROM (SELECT sum(f) AS f, max(n) AS n FROM n GROUP BY w)), et AS (SELECT -sum(f / n * log2(f / n)) AS h FROM (SELECT sum(f) AS f, max(n) AS n FROM n GROUP BY tag))
SELECT round(e.h, 6) AS h_joint, round(ew.h, 6) AS h_w, round(et.h, 6) AS h_tag, round(ew.h + et.h - e.h, 6) AS mi, round(e.h - ew.h, 6) AS h_tag_given_w, round(e.h - et.h, 6) AS h_w_given_tag FROM e, ew, et""", "tok")
def _(s, d):
    out = evaluation.information(kept(tagged(s, d).groupBy("w", "tag").agg(F.count("*").alias("f")), "lexicon"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("mapeval_expect", _LEX + ", n AS (SELECT f, sum(f) OVER () AS n, sum(f) OVER (PARTITION BY w) AS fw, sum(f) OVER (PARTITION BY tag) AS ft FROM lex) SELECT round(sum(f * f / n / fw), 6) AS precision, round(sum(f * f / n / ft), 6) AS recall FROM n", "tok")
def _(s, d):
    out = evaluation.expected_agreement(tagged(s, d).groupBy("w", "tag").agg(F.count("*").alias("f")))
    return out.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


# Tries and morphology.


@query("trie_prefix_freq", "SELECT prefix, CAST(depth AS BIGINT) AS depth, CAST(sum(f) AS BIGINT) AS f, CAST(count(*) AS BIGINT) AS words FROM (SELECT f, substr(w, 1, k) AS prefix, k AS depth FROM (SELECT w, f, unnest(range(0, length(w) + 1)) AS k FROM uni)) GROUP BY ALL", "tok")
def _(s, d):
    return trie.prefixes(unigrams(s, d))


@query("trie_suffix_freq", "SELECT prefix, CAST(depth AS BIGINT) AS depth, CAST(sum(f) AS BIGINT) AS f, CAST(count(*) AS BIGINT) AS words FROM (SELECT f, substr(w, 1, k) AS prefix, k AS depth FROM (SELECT reverse(w) AS w, f, unnest(range(0, length(w) + 1)) AS k FROM uni)) GROUP BY ALL", "tok")
def _(s, d):
    return trie.prefixes(unigrams(s, d), reverse=True)


_WIDTHS = ", pre AS (SELECT DISTINCT substr(w, 1, k) AS prefix, substr(w, k + 1, 1) AS c FROM (SELECT w, unnest(range(0, length(w))) AS k FROM uni)), wid AS (SELECT prefix, CAST(count(*) AS BIGINT) AS width FROM pre GROUP BY prefix)"


@query("trie_width", _WIDTHS + " SELECT prefix, width FROM wid", "tok")
def _(s, d):
    return trie.widths(unigrams(s, d))


@query("trie_pairs", ", sp AS (SELECT substr(w, 1, k) AS stem, substr(w, k + 1) AS suffix FROM (SELECT w, unnest(range(0, length(w) + 1)) AS k FROM uni)) SELECT suffix, CAST(count(*) AS BIGINT) AS stems FROM sp GROUP BY suffix HAVING count(*) > 1", "tok")
def _(s, d):
    return trie.splits(unigrams(s, d)).groupBy("suffix").agg(F.count("*").alias("stems")).where("stems > 1")


_CUTS = _WIDTHS + """, ch AS (SELECT w, k AS pos, coalesce(width, 0) AS width FROM (SELECT w, unnest(range(1, length(w) + 1)) AS k FROM uni WHERE length(w) > 3) LEFT JOIN wid ON substr(w, 1, k) = prefix),
nb AS (SELECT *, lag(width) OVER o AS a, lead(width) OVER o AS b FROM ch WINDOW o AS (PARTITION BY w ORDER BY pos)),
cuts AS (SELECT w, CAST(max(pos) AS BIGINT) AS cut FROM nb WHERE a <= 1 AND width > 1 AND b <= 1 AND pos >= 3 AND length(w) - pos <= 5 GROUP BY w)"""


@query("goldsmith_cuts", _CUTS + " SELECT w, cut FROM cuts", "tok")
def _(s, d):
    return trie.successor_cuts(kept(unigrams(s, d).select("w"), "words"))


_SIGNATURES = _CUTS + """, c AS (SELECT substr(w, 1, cut) AS stem, substr(w, cut + 1) AS suffix FROM cuts), a AS (SELECT * FROM c UNION ALL SELECT w, 'NULL' FROM uni WHERE w IN (SELECT stem FROM c)),
sg AS (SELECT stem, string_agg(suffix, ',' ORDER BY suffix) AS signature, CAST(count(*) AS BIGINT) AS suffixes FROM (SELECT DISTINCT * FROM a) GROUP BY stem)"""


@query("signatures", _SIGNATURES + " SELECT stem, signature, suffixes FROM sg", "tok")
def _(s, d):
    words = kept(unigrams(s, d).select("w"), "words")
    return trie.signatures(words, kept(trie.successor_cuts(words), "cuts"))


@query("signature_model", _SIGNATURES + " SELECT signature, CAST(count(*) AS BIGINT) AS stems, round(log2(26.0) * (avg(length(stem)) * (max(suffixes) - 1) + max(length(regexp_replace(signature, ',|NULL', '', 'g')) / suffixes) * (count(*) - 1)), 4) AS robustness FROM sg GROUP BY signature", "tok")
def _(s, d):
    words = kept(unigrams(s, d).select("w"), "words")
    return trie.signature_model(trie.signatures(words, kept(trie.successor_cuts(words), "cuts"))).withColumn("robustness", F.round("robustness", 4))


# Scalar functions on the counts of words.


@query("log_factorial", "SELECT f, round(lgamma(f + 1), 4) AS v FROM (SELECT DISTINCT f FROM uni)", "tok")
def _(s, d):
    return unigrams(s, d).select("f").distinct().select("f", F.round(scalar.log_factorial(F.col("f")), 4).alias("v"))


@query("log_domain", "SELECT w, round(ln(f / n + 1 / n), 6) AS sum, round(CASE WHEN f <> 1 THEN ln(abs(f / n - 1 / n)) END, 6) AS difference FROM (SELECT w, f, sum(f) OVER () AS n FROM uni)", "tok")
def _(s, d):
    u = distribution.normalized(unigrams(s, d)).withColumn("one", F.col("p") / F.col("f"))
    x, y = F.log("p"), F.log("one")
    return u.select("w", F.round(scalar.log_add(x, y), 6).alias("sum"), F.round(F.when(F.col("f") != 1, scalar.log_difference(x, y)), 6).alias("difference"))


# Models that SQL cannot express.


_TAGS = ", lx AS (SELECT doc_id, sid, pos, w, lang || CASE WHEN length(w) <= 3 THEN '_short' ELSE '_long' END AS tag FROM tok)"


def _word_tags(s, d):
    """A tag for each word, which varies within sentences: the language and whether the word is short."""
    return toks(s, d).withColumn("tag", F.concat("lang", F.when(F.length("w") <= 3, "_short").otherwise("_long")))


def _model(s, d):
    t = _word_tags(s, d)
    emissions, transitions = hmm_tables.supervised_counts(t.select("doc_id", "sid", "pos", "w", "tag"), ["doc_id", "sid"])
    return hmm_tables.compiled(kept(emissions, "lexicon"), kept(transitions, "moves"))


@query("hmm_transitions", _TAGS + """, x AS (SELECT doc_id, sid, list_concat(['__$'], list(tag ORDER BY pos), ['__$']) AS p FROM lx GROUP BY doc_id, sid), y AS (SELECT doc_id, sid, unnest(p) AS t, generate_subscripts(p, 1) AS k FROM x),
m AS (SELECT t1, t2, count(*) AS f FROM (SELECT t AS t1, lead(t) OVER (PARTITION BY doc_id, sid ORDER BY k) AS t2 FROM y) WHERE t2 IS NOT NULL GROUP BY ALL),
g AS (SELECT a.t1, b.t2, coalesce(m.f, 0) AS f FROM (SELECT DISTINCT t1 FROM m) a CROSS JOIN (SELECT DISTINCT t2 FROM m) b LEFT JOIN m ON m.t1 = a.t1 AND m.t2 = b.t2 WHERE NOT (a.t1 = '__$' AND b.t2 = '__$')),
q AS (SELECT t1, t2, f + 0.01 * (SELECT min(f) FROM m) AS f FROM g) SELECT t1, t2, round(CAST(f / sum(f) OVER (PARTITION BY t1) AS DOUBLE), 9) AS p FROM q""", "tok")
def _(s, d):
    """Transition probabilities, smoothed by a hundredth of the least joint one."""
    t = _word_tags(s, d)
    moves = hmm_tables.supervised_counts(t.select("doc_id", "sid", "pos", "w", "tag"), ["doc_id", "sid"])[1]
    return hmm_tables.transition_probabilities(kept(moves, "moves")).withColumn("p", F.round("p", 9))


@query("hmm_emissions", _TAGS + """, l AS (SELECT w, tag, count(*) AS f FROM lx GROUP BY ALL), s AS (SELECT sum(f) AS n, min(f) AS m, count(DISTINCT w) AS v FROM l), o AS (SELECT tag, sum(f) AS ft FROM l GROUP BY tag)
SELECT g.w, g.tag, round(CAST((coalesce(l.f, 0) + 0.01 * s.m) / (g.ft + 0.01 * s.m * s.v) AS DOUBLE), 9) AS p FROM (SELECT w, tag, ft FROM (SELECT DISTINCT w FROM l), o) g LEFT JOIN l ON l.w = g.w AND l.tag = g.tag, s""", "tok")
def _(s, d):
    """Emission probabilities of every word under every tag, smoothed likewise."""
    lex = kept(_word_tags(s, d).groupBy("w", "tag").agg(F.count("*").alias("f")), "lexicon")
    return hmm_tables.emission_grid(lex).withColumn("p", F.round("p", 9))


@query("hmm_best_tags", _LEX + ", r AS (SELECT w, tag, f / sum(f) OVER (PARTITION BY w) AS p, row_number() OVER (PARTITION BY w ORDER BY f DESC, tag) AS rank FROM lex) SELECT w, tag, round(p, 9) AS p, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 2", "tok")
def _(s, d):
    return hmm_tables.best_tags(kept(tagged(s, d).groupBy("w", "tag").agg(F.count("*").alias("f")), "lexicon"), 2).withColumn("p", F.round("p", 9))


@query("hmm_restricted", _LEX + ", r AS (SELECT *, sum(f) OVER (PARTITION BY w) AS n FROM lex) SELECT w, tag, f FROM r WHERE f >= 0.3 * n", "tok")
def _(s, d):
    """Words without their rare tags."""
    return hmm_tables.restricted(kept(tagged(s, d).groupBy("w", "tag").agg(F.count("*").alias("f")), "lexicon"), 0.3)


@query("hmm_viterbi")
def _(s, d):
    """The likeliest tags of every sentence under a supervised model of the whole vocabulary."""
    return hmm_tables.tagged(sents(s, d), _model(s, d), ["doc_id", "sid"]).withColumn("logp", F.round("logp", 6))


@query("hmm_posterior")
def _(s, d):
    """The likeliest tag of each place of every sentence by itself."""
    return hmm_tables.tagged(sents(s, d), _model(s, d), ["doc_id", "sid"], "posterior").withColumn("logp", F.round("logp", 6))


@query("hmm_reestimate")
def _(s, d):
    """Expected counts of one round of re-estimation over every sentence, emissions of every word among them."""
    return hmm_tables.expected_counts(sents(s, d), _model(s, d), ["doc_id", "sid"]).withColumn("f", F.round("f", 4))
