"""Queries that write each file format to the shared folder and read it again, and small ones over parses and counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.storage import kept, shared_folder, table
from ..operators import evaluation, hmm_tables, trie
from ..sources import files
from .registry import query
from .text import _LEX, _SIGNATURES, bigrams, sents, tagged, unigrams


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/wordloom-kept/{name}-{uuid.uuid4().hex}"


def _sentences(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, sid, toks): sentences of tokens whose tag is the language and whose details are the document's source."""
    token = lambda w: F.struct(w.alias("text"), F.col("lang").alias("tag"), F.array("source").alias("details"))
    return sents(s, d).where("lang is not null and source is not null").select("doc_id", "sid", F.transform("toks", token).alias("toks"))


def _lines(read: DataFrame, detail: bool = False) -> DataFrame:
    """How often each sentence was read, with its tags, and details, as text."""
    parts = [F.transform("toks", lambda t: t[c]) for c in ("text", "tag")] + ([F.transform("toks", lambda t: F.get(t["details"], F.lit(0)))] if detail else [])
    rows = read.select(*[F.array_join(p, " ").alias(c) for p, c in zip(parts, ("line", "tags", "sources"), strict=False)])
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


_LINES = " SELECT array_to_string(toks, ' ') AS line, array_to_string(list_transform(toks, lambda t: lang), ' ') AS tags{0}, CAST(count(*) AS BIGINT) AS n FROM sents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL"
_PLAIN, _DETAILED = _LINES.format(""), _LINES.format(", array_to_string(list_transform(toks, lambda t: source), ' ') AS sources")


@query("file_tt", _DETAILED, "tok")
def _(s, d):
    at = _folder(s, "tt")
    files.write_tt(_sentences(s, d), at, ["doc_id", "sid"])
    return _lines(files.read_corpus(s, at, "tt"), detail=True)


@query("file_brown", _PLAIN, "tok")
def _(s, d):
    at = _folder(s, "brown")
    files.write_separated(_sentences(s, d), at, "/")
    return _lines(files.read_corpus(s, at, "brown"))


@query("file_lob", _PLAIN, "tok")
def _(s, d):
    at = _folder(s, "lob")
    files.write_separated(_sentences(s, d), at, "_")
    return _lines(files.read_corpus(s, at, "lob"))


@query("file_xml", _PLAIN, "tok")
def _(s, d):
    at = _folder(s, "xml")
    files.write_xml(_sentences(s, d), at)
    return _lines(files.read_corpus(s, at, "xml"))


@query("file_xml_path", _PLAIN, "tok")
def _(s, d):
    """The same elements, found by their paths."""
    at = _folder(s, "xml")
    files.write_xml(_sentences(s, d), at, "sentence", "w")
    return _lines(files.read_xml_by_path(s, at, "sentence", "w", tag="@tag"))


@query("file_parquet", _DETAILED, "tok")
def _(s, d):
    at = _folder(s, "parquet")
    files.write_files(_sentences(s, d), at, 3)
    return _lines(files.read_corpus(s, at, "parquet"), detail=True)


@query("file_list", _PLAIN.replace("GROUP BY", "AND lang IN ('en', 'de') GROUP BY"), "tok")
def _(s, d):
    """A file for each language, of which a list names all; two are selected."""
    at, every = _folder(s, "list"), kept(_sentences(s, d), "sentences")
    paths = []
    for lang in ("en", "fr", "de", "es"):
        paths.append(f"{at}/{lang}")
        files.write_tt(every.where(F.col("toks")[0]["tag"] == lang), paths[-1], ["doc_id", "sid"])
    s.createDataFrame([("%% corpora",), *((p,) for p in paths)], "value string").coalesce(1).write.text(f"{at}/list")
    return _lines(files.read_file_list(s, f"{at}/list", select="/(en|de|fr)$", ignore="/fr$"))


@query("file_distribution", " SELECT w, CAST(f AS DOUBLE) AS f FROM uni", "tok")
def _(s, d):
    at = _folder(s, "dist")
    files.write_distribution(unigrams(s, d), at)
    return files.read_distribution(s, at)


@query("file_lexicon", _LEX + " SELECT w, tag, CAST(f AS DOUBLE) AS f FROM lex WHERE tag IS NOT NULL", "tok")
def _(s, d):
    at = _folder(s, "lex")
    files.write_lexicon(tagged(s, d).where("tag is not null").groupBy("w", "tag").agg(F.count("*").alias("f")), at)
    return files.read_lexicon(s, at)


@query("file_ngrams", " SELECT w1, w2, CAST(f AS DOUBLE) AS f FROM big", "big")
def _(s, d):
    at = _folder(s, "123")
    files.write_ngrams(bigrams(s, d), at, 2)
    return files.read_ngrams(s, at, 2)


@query("file_map", " SELECT w AS k, CAST(f AS VARCHAR) AS v FROM uni", "tok")
def _(s, d):
    at = _folder(s, "map")
    files.write_map(unigrams(s, d).select(F.col("w").alias("k"), F.col("f").alias("v")), at)
    return files.read_map(s, at)


@query("file_set", " SELECT w AS k FROM uni", "tok")
def _(s, d):
    at = _folder(s, "set")
    files.write_set(unigrams(s, d), "w", at)
    return files.read_set(s, at)


@query("file_enum", " SELECT w AS sym, CAST(row_number() OVER (ORDER BY w) - 1 AS BIGINT) AS id FROM uni", "tok")
def _(s, d):
    from ..operators import dictionary

    at = _folder(s, "enum")
    files.write_enum(dictionary.dictionary(unigrams(s, d), "w"), at)
    return files.read_enum(s, at)


@query("file_matrix", "SELECT CAST(n_regionkey AS VARCHAR) AS row, upper(left(n_name, 1)) AS \"column\", CAST(count(*) AS DOUBLE) AS value FROM nation GROUP BY ALL")
def _(s, d):
    """Nations by region and first letter, as a dense table."""
    at = _folder(s, "matrix")
    cells = table(s, d, "nation").groupBy(F.col("n_regionkey").alias("r"), F.upper(F.substring("n_name", 1, 1)).alias("c")).agg(F.count("*").alias("n"))
    files.write_matrix(cells, at, "r", "c", "n", [chr(x) for x in range(ord("A"), ord("Z") + 1)])
    return files.read_matrix(s, at)


@query("file_table", "SELECT CAST(c_custkey AS VARCHAR) AS key, coalesce(c_mktsegment, '0') AS segment, CAST(c_nationkey AS VARCHAR) AS \"key(2)\" FROM customer")
def _(s, d):
    """Customers as a table whose titles are numbered and repeat."""
    at = _folder(s, "table")
    rows = table(s, d, "customer").select(F.concat_ws("\t", F.col("c_custkey").cast("string"), F.coalesce("c_mktsegment", F.lit("0")), F.col("c_nationkey").cast("string")).alias("value"))
    rows.write.text(at)
    s.createDataFrame([("#1(key)\tsegment_2\t3(key)",)], "value string").coalesce(1).write.mode("append").text(at)
    return files.read_table(s, at)


@query("file_table_saved", "SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS VARCHAR) AS cust FROM orders")
def _(s, d):
    """A table in which null is written as 0."""
    at = _folder(s, "table")
    files.write_table(table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("cust")), at)
    return s.read.option("sep", "\t").option("header", True).csv(at)


@query("file_variables", "SELECT 'n' || n_nationkey AS name, '?=' AS op, n_name AS value FROM nation")
def _(s, d):
    at = _folder(s, "mak")
    table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(" ?= "), "n_name", F.lit(" # nation")).alias("value")).write.text(at)
    return files.read_variables(s, at)


@query("file_hmm", _LEX + " SELECT w AS a, tag AS b, CAST(f AS DOUBLE) AS f, 'lexicon' AS kind FROM lex WHERE tag IS NOT NULL UNION ALL SELECT w1, w2, CAST(f AS DOUBLE), 'moves' FROM big", "big")
def _(s, d):
    """Counts of a model: languages as tags, and bigrams in the place of moves."""
    at = _folder(s, "hmm")
    lex = tagged(s, d).where("tag is not null").groupBy("w", "tag").agg(F.count("*").alias("f"))
    files.write_hmm(lex, bigrams(s, d).select(F.col("w1").alias("t1"), F.col("w2").alias("t2"), "f"), at)
    lex, moves = files.read_hmm(s, at)
    return lex.select(F.col("w").alias("a"), F.col("tag").alias("b"), "f", F.lit("lexicon").alias("kind")).unionByName(moves.select(F.col("t1").alias("a"), F.col("t2").alias("b"), "f", F.lit("moves").alias("kind")))


_PARSED = """, pa AS (SELECT w, CASE WHEN length(w) >= 4 THEN regexp_replace(w, '^(re|un|in)(..+)$', '\\1.\\2') END AS seg1, CASE WHEN length(w) >= 5 THEN regexp_replace(w, '^(..+)(ing|ed|s|ly|tion)$', '\\1.\\2') END AS seg2, f FROM uni),
pl AS (SELECT *, CASE WHEN seg1 LIKE '%.%' THEN strpos(seg1, '.') - 1 END AS a, CASE WHEN seg2 LIKE '%.%' THEN strpos(seg2, '.') - 1 END AS b FROM pa),
pb AS (SELECT 'token' AS unit, * FROM pl UNION ALL SELECT 'type', w, seg1, seg2, 1, a, b FROM pl),
ps AS (SELECT unit, sum(f) AS n, sum(CASE WHEN seg1 IS NOT NULL THEN f ELSE 0 END) / sum(f) AS c1, sum(CASE WHEN seg2 IS NOT NULL THEN f ELSE 0 END) / sum(f) AS c2,
 sum(CASE WHEN seg1 IS NOT NULL AND seg2 IS NOT NULL AND a = b THEN f ELSE 0 END) AS r, sum(CASE WHEN seg1 IS NOT NULL AND seg2 IS NOT NULL AND a IS NOT NULL THEN f ELSE 0 END) AS fd, sum(CASE WHEN seg1 IS NOT NULL AND seg2 IS NOT NULL AND b IS NOT NULL THEN f ELSE 0 END) AS wt FROM pb GROUP BY unit)"""


@query("morph_report", _PARSED + " SELECT unit, CAST(n AS BIGINT) AS n, round(c1, 9) AS coverage1, round(c2, 9) AS coverage2, CAST(r AS BIGINT) AS \"right\", CAST(fd AS BIGINT) AS found, CAST(wt AS BIGINT) AS wanted, round(r / nullif(fd, 0), 9) AS precision, round(r / nullif(wt, 0), 9) AS recall, round(2 * r / nullif(fd + wt, 0), 9) AS f1 FROM ps", "tok")
def _(s, d):
    """Cuts after prefixes against cuts before suffixes, by token and by type; short words have no parse."""
    cut = lambda least, pattern: F.when(F.length("w") >= least, F.regexp_replace("w", pattern, "$1.$2"))
    words = unigrams(s, d).select("w", cut(4, "^(re|un|in)(..+)$").alias("seg1"), cut(5, "^(..+)(ing|ed|s|ly|tion)$").alias("seg2"), "f")
    out = evaluation.segmentation_report(words)
    f1 = F.when(F.col("found") + F.col("wanted") > 0, 2 * F.col("right") / (F.col("found") + F.col("wanted")))
    return out.withColumn("f1", f1).select("unit", "n", "right", "found", "wanted", *[F.round(c, 9).alias(c) for c in ("coverage1", "coverage2", "precision", "recall", "f1")])


_SUFFIXED = _SIGNATURES + ", sx AS (SELECT stem, unnest(string_split(signature, ',')) AS suffix FROM sg)"


def _stems(s, d):
    words = kept(unigrams(s, d).select("w"), "words")
    return kept(trie.signatures(words, kept(trie.successor_cuts(words), "cuts")), "stems")


@query("signatures_common", _SUFFIXED + ", ok AS (SELECT suffix FROM sx GROUP BY suffix HAVING count(*) >= 3) SELECT stem, string_agg(suffix, ',' ORDER BY suffix) AS signature, CAST(count(*) AS BIGINT) AS suffixes FROM sx WHERE suffix IN (SELECT suffix FROM ok) GROUP BY stem", "tok")
def _(s, d):
    """Signatures without suffixes of fewer than three stems."""
    return trie.without_rare_suffixes(_stems(s, d))


@query("signatures_sound", _SUFFIXED + ", sz AS (SELECT signature, count(*) AS n FROM sg GROUP BY signature), ok AS (SELECT signature FROM sz WHERE n >= 25 OR len(list_filter(string_split(signature, ','), lambda f: f = 'NULL' OR length(f) >= 2)) >= 2) SELECT stem, signature, suffixes FROM sg WHERE signature IN (SELECT signature FROM ok)", "tok")
def _(s, d):
    """Stems whose signature many stems share or that has two suffixes of some length."""
    return trie.without_doubtful_signatures(_stems(s, d))


@query("binomials", " SELECT DISTINCT f, round(exp(lgamma(f + 1) - lgamma(3) - lgamma(f - 1)) * power(0.1, 2) * power(0.9, f - 2), 9) AS p FROM uni WHERE f >= 2", "tok")
def _(s, d):
    """The probability of two successes of one in ten, for each count."""
    counts = unigrams(s, d).where("f >= 2").select("f").distinct()
    return counts.select("f", F.round(scalar.binomial_probability(F.col("f"), F.lit(2), F.lit(0.1)), 9).alias("p"))


@query("run_lengths", ", x AS (SELECT doc_id, sid, pos, length(w) AS n FROM tok), c AS (SELECT *, CASE WHEN n = lag(n) OVER (PARTITION BY doc_id, sid ORDER BY pos) THEN 0 ELSE 1 END AS o FROM x), r AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, sid ORDER BY pos) AS run FROM c), g AS (SELECT doc_id, sid, run, any_value(n) AS value, count(*) AS many FROM r GROUP BY doc_id, sid, run) SELECT CAST(value AS BIGINT) AS value, CAST(many AS BIGINT) AS many, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY value, many", "tok")
def _(s, d):
    """How often a run of so many words of one length stands in a sentence."""
    runs = sents(s, d).select(F.explode(scalar.run_lengths(F.transform("toks", lambda w: F.length(w)))).alias("r"))
    return runs.groupBy("r.value", "r.many").agg(F.count("*").alias("n"))


@query("rounded_half_up", "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 2 + 0.5) AS BIGINT) AS half FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.round_half_up(F.col("l_quantity") / 2).cast("long").alias("half"))


@query("hmm_frequencies", _LEX + ", n AS (SELECT tag, sum(f) AS n FROM lex GROUP BY tag) SELECT w, lex.tag AS tag, CAST(f AS DOUBLE) AS f FROM lex JOIN n ON n.tag = lex.tag", "tok")
def _(s, d):
    """Emission probabilities as rounded counts again."""
    lex = kept(tagged(s, d).where("tag is not null").groupBy("w", "tag").agg(F.count("*").alias("f")), "lexicon")
    totals = lex.groupBy("tag").agg(F.sum("f").alias("n"))
    p = lex.join(totals, "tag").select("w", "tag", (F.col("f") / F.col("n")).alias("p"))
    return hmm_tables.frequencies(p, totals, "tag", rounded=True).select("w", "tag", F.col("f").cast("double").alias("f"))


@query("log_forms", "SELECT l_orderkey, l_linenumber, round(CASE WHEN x > 0 THEN log2(x) ELSE 0 END, 9) AS two, round(CASE WHEN x > 0 THEN ln(x) ELSE 0 END, 9) AS natural, round(CASE WHEN x > 0 THEN log10(x) ELSE 0 END, 9) AS ten, round(CASE WHEN x > 0 THEN log2(x) ELSE -99 END, 9) AS marked FROM (SELECT l_orderkey, l_linenumber, l_discount AS x FROM lineitem)")
def _(s, d):
    """Logarithms of discounts, of which many are 0."""
    x = F.col("l_discount")
    forms = {"two": scalar.log2_or_zero(x), "natural": scalar.log_or_zero(x), "ten": scalar.log_or_zero(x, 10), "marked": scalar.log2_or_zero(x, -99.0)}
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(n) for n, c in forms.items()])


@query("plain_titles", "SELECT DISTINCT p_type, regexp_replace(p_type, '[^A-Za-z0-9_]+', '_', 'g') AS title FROM part")
def _(s, d):
    return table(s, d, "part").select("p_type", scalar.plain_name(F.col("p_type")).alias("title")).distinct()


@query("coll_only", "SELECT o_orderkey, 'priority=>' || o_orderpriority || ' && status=>' || o_orderstatus AS key FROM orders")
def _(s, d):
    """Orders as records cut to two variables."""
    from ..operators import collection
    from .records import _records

    return collection.keyed(collection.only(_records(s, d), ["status", "priority"])).select("o_orderkey", "key")


@query("enum_grown", ", a AS (SELECT DISTINCT w FROM tok WHERE lang = 'en'), b AS (SELECT DISTINCT w FROM tok WHERE w NOT IN (SELECT w FROM a)) SELECT w AS sym, CAST(row_number() OVER (ORDER BY w) - 1 AS BIGINT) AS id FROM a UNION ALL SELECT w, CAST(row_number() OVER (ORDER BY w) - 1 + (SELECT count(*) FROM a) AS BIGINT) FROM b", "tok")
def _(s, d):
    """A dictionary of English words to which all others are added."""
    from ..operators import dictionary
    from .text import toks

    words = kept(toks(s, d).select(F.col("w").alias("sym"), "lang").distinct(), "words")
    english = kept(dictionary.dictionary(words.where("lang = 'en'"), "sym"), "english")
    return dictionary.grown(english, words)


@query("enum_vectors_grown", "WITH v AS (SELECT CAST(embedding[1:3] AS INTEGER[]) AS v, vec_id FROM embeddings), a AS (SELECT DISTINCT v FROM v WHERE vec_id < 100), b AS (SELECT DISTINCT v FROM v WHERE v NOT IN (SELECT v FROM a)) SELECT array_to_string(v, ' ') AS sym, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS id FROM a UNION ALL SELECT array_to_string(v, ' '), CAST(row_number() OVER (ORDER BY v) - 1 + (SELECT count(*) FROM a) AS BIGINT) FROM b")
def _(s, d):
    """A dictionary of rounded vectors, to which those of later ids are added."""
    from ..operators import dictionary

    short = F.transform(F.slice("embedding", 1, 3), lambda x: F.rint(x).cast("int"))
    vectors = kept(table(s, d, "embeddings").select(short.alias("sym"), "vec_id"), "vectors")
    first = kept(dictionary.vectors(vectors.where("vec_id < 100"), "sym"), "first")
    return dictionary.grown(first, vectors).select(F.array_join("sym", " ").alias("sym"), "id")


@query("enum_forced", ", e AS (SELECT w AS sym, row_number() OVER (ORDER BY w) - 1 AS id FROM uni), p AS (SELECT w AS sym, 2 * (row_number() OVER (ORDER BY f DESC, w) - 1) AS id FROM uni ORDER BY f DESC, w LIMIT 200) SELECT sym, CAST(id AS BIGINT) AS id FROM p UNION ALL SELECT sym, CAST(id AS BIGINT) FROM e WHERE sym NOT IN (SELECT sym FROM p) AND id NOT IN (SELECT id FROM p)", "tok")
def _(s, d):
    """A dictionary in which the 200 most frequent words get the first even ids."""
    from pyspark.sql import Window

    from ..operators import dictionary

    uni = kept(unigrams(s, d), "unigrams")
    top = uni.orderBy(F.desc("f"), "w").limit(200).select(F.col("w").alias("sym"), (2 * (F.row_number().over(Window.orderBy(F.desc("f"), "w")) - 1)).cast("long").alias("id"))  # 200 rows
    return dictionary.forced(kept(dictionary.dictionary(uni, "w"), "enum"), kept(top, "top"))
