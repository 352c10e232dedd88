"""Queries over decompositions, restarts of k-means, acceptors of sentences, numbered trees, fits and normalised tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import kept, table
from ..operators import clustering, corpus, fitting, multistage, normalization, sparse_rows, sparse_svd, tree_order, trie
from .records import _DISTANCE, _points
from .registry import query
from .shapes import _TREE, _tree
from .text import counted, sents, toks, unigrams

_STARTS = "SELECT CAST((n - 1) // 5 AS INTEGER) AS run, CAST((n - 1) % 5 AS INTEGER) AS cluster, c FROM (SELECT row_number() OVER (ORDER BY vec_id) AS n, CAST(embedding AS DOUBLE[]) AS c FROM embeddings) WHERE n <= 15"


def _starts(s, d):
    """Three runs of five centres: the first fifteen vectors."""
    from pyspark.sql import Window

    first = _points(s, d).orderBy("id").limit(15)
    n = F.row_number().over(Window.orderBy("id")) - 1  # fifteen rows
    return first.select(F.floor(n / 5).cast("int").alias("run"), (n % 5).cast("int").alias("cluster"), F.col("v").alias("centre"))


def _runs_sql(distance: str, middle: str) -> str:
    assign = "SELECT run, id, cluster, d FROM (SELECT s.run, p.id, s.cluster, {d} AS d, row_number() OVER (PARTITION BY s.run, p.id ORDER BY {d}, s.cluster) AS r FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) p, {s} s) WHERE r = 1".replace("{d}", _DISTANCE[distance])
    return f"""WITH s0 AS ({_STARTS}), a0 AS MATERIALIZED ({assign.replace('{s}', 's0')}),
e0 AS (SELECT run, cluster, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM a0 JOIN embeddings ON vec_id = id),
s1 AS MATERIALIZED (SELECT run, cluster, list(x ORDER BY pos) AS c FROM (SELECT run, cluster, pos, {middle}(x) AS x FROM e0 GROUP BY ALL) GROUP BY run, cluster), a1 AS MATERIALIZED ({assign.replace('{s}', 's1')})"""


for _name, _distance, _how, _middle in (("means", "l2", "mean", "avg"), ("medians", "l1", "median", "median")):

    def _add_runs(name: str, distance: str, how: str, middle: str) -> None:
        sql = _runs_sql(distance, middle)

        @query(f"k{name}_runs", sql + " SELECT run, id, cluster FROM a1")
        def _(s, d):
            """Two rounds from three starts at once."""
            return clustering.kmeans_runs(_points(s, d).drop("cluster"), _starts(s, d), distance, how, rounds=2)[0].select("run", "id", "cluster")

        @query(f"k{name}_best", sql + ", b AS (SELECT run FROM a1 GROUP BY run ORDER BY round(sum(d), 9), run LIMIT 1) SELECT id, cluster FROM a1 WHERE run IN (SELECT run FROM b)")
        def _(s, d):
            """The run whose distances have the least sum."""
            return clustering.best_run(*clustering.kmeans_runs(_points(s, d).drop("cluster"), _starts(s, d), distance, how, rounds=2))

    _add_runs(_name, _distance, _how, _middle)


@query("kmeans_restarts")
def _(s, d):
    """The best of eight starts by hashes, each run to its end."""
    points = _points(s, d).drop("cluster")
    return clustering.best_run(*clustering.kmeans_runs(points, clustering.hashed_starts(points, 10, 8)))


def _profiles(s, d):
    """The neighbours' distributions of all words."""
    uni, big = counted(s, d)
    return kept(sparse_rows.shares(multistage.cells(big, uni.select("w"))), "profiles")


@query("svd_sparse")
def _(s, d):
    """Every word in the space of the sixteen largest singular values of all words' neighbours."""
    rows = _profiles(s, d)
    return sparse_svd.applied(rows, sparse_svd.decomposed(rows, 16, rounds=6, tolerance=1e-6))


def _acceptor_sql(order: str) -> str:
    return f""", p AS (SELECT doc_id, sid, list_concat(['__$'], {order}, ['__$']) AS p FROM sents), e AS (SELECT doc_id, sid, p, unnest(p) AS label, generate_subscripts(p, 1) - 1 AS depth FROM p),
a AS (SELECT depth, p[1:depth] AS state, label, min({{'doc_id': doc_id, 'sid': sid}}) AS own, count(*) AS f FROM e GROUP BY ALL)
SELECT CAST(depth AS INTEGER) AS depth, (min(own) OVER (PARTITION BY depth, state)).doc_id AS doc_id, (min(own) OVER (PARTITION BY depth, state)).sid AS sid, label, CAST(f AS BIGINT) AS f FROM a"""


for _name, _reverse in (("prefix", False), ("suffix", True)):

    def _add_acceptor(name: str, reverse: bool) -> None:
        @query(f"acceptor_{name}_words", _acceptor_sql("list_reverse(toks)" if reverse else "toks"), "tok")
        def _(s, d):
            """The tree acceptor of all sentences; a state is named by the first sentence that reaches it."""
            arcs = trie.sentence_acceptor(sents(s, d), ["doc_id", "sid"], corpus.EDGE, reverse)
            return arcs.select("depth", "first.doc_id", "first.sid", "label", "f")

    _add_acceptor(_name, _reverse)


_NUMBERS = _TREE + """, sz AS (SELECT substr(node, 1, k) AS node, count(*) AS size FROM (SELECT node, unnest(range(1, length(node) + 1)) AS k FROM nodes) GROUP BY ALL),
nb AS (SELECT node, parent, row_number() OVER (ORDER BY node) - 1 AS pre, CAST(length(node) - 1 AS BIGINT) AS depth, size FROM nodes JOIN sz USING (node))"""


@query("tree_numbers", _NUMBERS + " SELECT node, parent, CAST(pre AS BIGINT) AS pre, CAST(pre + size - 1 - depth AS BIGINT) AS post, depth, CAST(size AS BIGINT) AS size FROM nb", "tok")
def _(s, d):
    """The prefix tree of all words in pre-order and post-order."""
    return tree_order.numbered(_tree(s, d))


@query("tree_brackets", _NUMBERS + " SELECT CAST(2 * pre - depth AS BIGINT) AS place, '(' || node AS piece FROM nb UNION ALL SELECT CAST(2 * (pre + size - 1 - depth) + depth + 1 AS BIGINT), ')' FROM nb", "tok")
def _(s, d):
    """Its canonical form, piece by piece."""
    return tree_order.bracketed(tree_order.numbered(_tree(s, d)))


@query("tree_ancestors", _TREE + ", q AS (SELECT w FROM uni ORDER BY f DESC, w LIMIT 100) SELECT w AS node, substr(w, 1, k) AS ancestor, CAST(length(w) - k AS INTEGER) AS up FROM (SELECT w, unnest(range(1, length(w))) AS k FROM q)", "tok")
def _(s, d):
    """What stands above the hundred most frequent words."""
    asked = unigrams(s, d).orderBy(F.desc("f"), "w").limit(100).select(F.col("w").alias("node"))
    return tree_order.ancestors(_tree(s, d), kept(asked, "asked"))


@query("tree_common", _NUMBERS + """, q AS (SELECT w, row_number() OVER (ORDER BY f DESC, w) AS r FROM uni), pr AS (SELECT a.w AS a, b.w AS b FROM q a JOIN q b ON a.r < b.r AND b.r <= 40),
cm AS (SELECT a, b, max(k) AS n FROM (SELECT a, b, unnest(range(1, length(a) + 1)) AS k FROM pr) WHERE left(a, k) = left(b, k) GROUP BY a, b) SELECT a, b, left(a, n) AS ancestor FROM pr LEFT JOIN cm USING (a, b)""", "tok")
def _(s, d):
    """The longest common prefixes of pairs of the forty most frequent words, as the lowest node above both."""
    from pyspark.sql import Window

    top = unigrams(s, d).orderBy(F.desc("f"), "w").limit(40).withColumn("r", F.row_number().over(Window.orderBy(F.desc("f"), "w")))  # forty rows
    top = kept(top, "asked")
    pairs = top.select(F.col("w").alias("a"), F.col("r").alias("ra")).join(F.broadcast(top.select(F.col("w").alias("b"), F.col("r").alias("rb"))), F.col("ra") < F.col("rb")).select("a", "b")
    return tree_order.common_ancestor(kept(tree_order.numbered(_tree(s, d)), "tree"), kept(pairs, "pairs"))


@query("gaussian_shares")
def _(s, d):
    """Values of events by the share of a fitted normal distribution below them, and the value that share stands for."""
    events = table(s, d, "events")
    fit = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    share = fitting.gaussian_cdf(F.col("value"), F.col("m"), F.col("s"))
    met = events.join(F.broadcast(fit), "event_type").select("event_id", "value", "m", "s", share.alias("share"))
    return met.select("event_id", F.round("share", 9).alias("share"), F.round(fitting.gaussian_quantile(F.col("share"), F.col("m"), F.col("s")) - F.col("value"), 6).alias("error"))


@query("offset_fit")
def _(s, d):
    """a, b and c of f = a rank^b + c over the ranks of all words' counts."""
    levels = kept(unigrams(s, d).groupBy("f").agg(F.count("*").alias("n")), "levels")
    from pyspark.sql import Window

    above = F.sum("n").over(Window.orderBy(F.desc("f"))) - F.col("n")  # a row for each different count
    a, b, c, error = fitting.offset_power_law(levels.select((above + (F.col("n") + 1) / 2).alias("rank"), F.log2(F.col("f") + 1.0).alias("f")), "rank", "f")
    return s.createDataFrame([(round(a, 6), round(b, 6), round(c, 6), round(error, 6))], "a double, b double, c double, error double")


_RULES = [(r"^[0-9]+$", "@CARD"), (r"[0-9]", "#"), (r"^(.)$", "@CHAR"), (r"^(..+)(?:ing|tion)$", "$1~"), (r"^un(...+)$", "un~$1")]


@query("norm_rules", " SELECT w, CASE WHEN regexp_matches(w, '^[0-9]+$') THEN '@CARD' WHEN regexp_matches(w, '[0-9]') THEN regexp_replace(w, '[0-9]', '#', 'g') WHEN regexp_matches(w, '^(.)$') THEN '@CHAR' WHEN regexp_matches(w, '^(..+)(?:ing|tion)$') THEN regexp_replace(w, '^(..+)(?:ing|tion)$', '\\1~') WHEN regexp_matches(w, '^un(...+)$') THEN regexp_replace(w, '^un(...+)$', 'un~\\1') ELSE w END AS norm, f FROM uni", "tok")
def _(s, d):
    """All words by five rules, the first that fits."""
    return normalization.by_rules(unigrams(s, d), _RULES).select("w", "norm", "f")


_TYPES = {
    "words_only": "WHERE type = 'word'",
    "card_types": "WHERE type IN ('word', 'card')",
    "card_literals": "WHERE type IN ('word', 'card')",
    "nonword_types": "",
    "nonword_literals": "",
}
for _mode, _where in _TYPES.items():

    def _add_typed(mode: str, where: str) -> None:
        new = "w" if mode.endswith("literals") else "'@' || upper(type)"

        @query(f"norm_{mode}", f", ty AS (SELECT w, CASE WHEN regexp_matches(w, '^[0-9]+$') THEN 'card' WHEN regexp_matches(w, '[0-9]') THEN 'mixed' ELSE 'word' END AS type FROM tok) SELECT CASE WHEN type = 'word' THEN left(w, 3) ELSE {new} END AS norm, CAST(count(*) AS BIGINT) AS f FROM ty {where} GROUP BY norm", "tok")
        def _(s, d):
            """Tokens by type: words by their first three letters, numbers and others as the mode has it."""
            kind = F.when(F.col("w").rlike("^[0-9]+$"), "card").when(F.col("w").rlike("[0-9]"), "mixed")
            return normalization.typed(toks(s, d).withColumn("type", kind), mode, F.substring("w", 1, 3)).groupBy("norm").agg(F.count("*").alias("f"))

    _add_typed(_mode, _where)
