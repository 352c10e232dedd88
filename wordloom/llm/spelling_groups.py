"""Groups of spelling variants over a relational trie (operator 13).

The words are the leaves of two tries, one of them of the words read backwards,
kept as a table of edges between the places where words part; an end mark closes
each word.  A state (word, place, node, edits) says that a word, read up to a
place with so many edits, leads to a node.  The states without an edit are the
nodes of a word's own path.  There an edit is opened, as the word parts from its
neighbour: its character is replaced by that of another edge, or left out.  From
then on the states are joined with the edges level by level, until none is left;
those that reach a leaf with one edit name a neighbour.  Two words apart by one
edit agree in the first or the last half of the longer one, so edits are opened
in the second half of each trie's words only, where few words are left below a
node.  What is inserted in one word is deleted in the other, so deletions and
replacements by larger characters find every pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .lexical_search import LOWER, UPPER

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO, ONE_IN = 7, 2, 10, 31
END = "$"
"""Closes each word in the tries; smaller than every letter."""
CHARS = 2_000_000
"""Characters of words whose paths are made at once."""
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, run): the maximal runs of letters of at least ``least`` code points, in which A to Z are made small."""
    found = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), found.alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def shortened(rows: DataFrame) -> DataFrame:
    """(word): of each run, one in ``ONE_IN`` of them with a code point left out, as the checksum of its document and itself says."""
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.withColumn("h", h).select(F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least ``LEAST_LENGTH`` code points found ``LEAST_COUNT`` times or more."""
    words = shortened(runs(docs)).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _paths(words: DataFrame) -> DataFrame:
    """(id, backward, depth, node, next): the nodes of each word's second half in either trie, and the character that follows there, 0 after the last."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch["word"].to_pylist(), batch["id"].to_numpy()
            size = np.array([len(t) for t in texts])
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), CHARS)) + lo)
                yield from _walked(texts[lo:hi], ids[lo:hi])
                lo = hi

    return words.select("id", "word").mapInArrow(walk, "id long, backward boolean, depth int, node long, next int")


def _walked(texts: list[str], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    for backward in (False, True):
        points = np.frombuffer("".join(t[::-1] if backward else t for t in texts).encode("utf-32-le"), "<u4").astype(np.uint64)
        inside = np.arange(len(points)) - np.repeat(begin, size)
        mixed = (points + np.uint64(7 + backward)) * _FACTOR
        mixed ^= mixed >> np.uint64(29)
        powers = np.cumprod(np.full(int(size.max()) + 1, _FACTOR))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers[inside])])  # a prefix's hash is a difference of sums, brought to one power
        owner = np.repeat(np.arange(len(texts)), size - size // 2 + 1)
        depth = np.arange(len(owner)) - np.repeat(np.cumsum(size - size // 2 + 1) - (size - size // 2 + 1), size - size // 2 + 1) + (size // 2)[owner]
        node = total[begin[owner] + depth] - total[begin[owner]]
        node = (node ^ (depth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * _FACTOR
        node ^= node >> np.uint64(31)
        after = np.where(depth < size[owner], np.append(points, 0)[np.minimum(begin[owner] + depth, len(points))], 0)
        for at in range(0, len(owner), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner[part]]), pa.array(np.full(len(owner[part]), backward)), pa.array(depth[part].astype(np.int32)), pa.array(node[part].view(np.int64)), pa.array(after[part].astype(np.int32))], names=["id", "backward", "depth", "node", "next"])


def _routes(words: DataFrame) -> DataFrame:
    """(backward, spelt, n, route): a word as it is read in a trie, closed by the end mark, with the (depth, node) on its path where words part."""
    paths = stored(_paths(words), "paths")
    parting = paths.groupBy("backward", "node").agg(F.min("next").alias("low"), F.max("next").alias("high")).where("low < high").select("backward", "node")
    met = paths.select("id", "backward", "depth", "node").join(stored(parting, "parting"), ["backward", "node"])
    route = met.groupBy("id", "backward").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("route"))  # of one word
    spelt = F.concat(F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word")), F.lit(END))
    return stored(route.join(words, "id").select("backward", spelt.alias("spelt"), "n", "route"), "routes")


def _edges(routes: DataFrame) -> DataFrame:
    """(backward, node, first, label, child, leaf, leaf_n, nexts): from each node to the next on some word's path, or to the word itself, a leaf.

    ``nexts`` has the characters that may follow at the child: no more than there are letters.
    """
    step = F.posexplode("route").alias("i", "at")
    walked = routes.select("backward", "spelt", "n", "route", step).withColumn("to", F.try_element_at("route", F.col("i") + 2))
    end = F.coalesce(F.col("to.depth"), F.length("spelt"))
    label = F.substring("spelt", F.col("at.depth") + 1, end - F.col("at.depth"))
    is_leaf = F.col("to").isNull()
    rows = walked.select("backward", F.col("at.node").alias("node"), label.alias("label"), F.col("to.node").alias("child"), F.when(is_leaf, F.col("spelt")).alias("leaf"), F.when(is_leaf, F.col("n")).alias("leaf_n"))
    edges = stored(rows.distinct().withColumn("first", F.substring("label", 1, 1)), "edges")
    nexts = edges.groupBy("backward", F.col("node").alias("child")).agg(F.array_join(F.collect_set("first"), "").alias("nexts"))
    return stored(edges.join(nexts, ["backward", "child"], "left"), "edges")


def _leads(after: Column, label: str = "label") -> Column:
    return F.startswith(after, F.col(label))


def _goes_on(frontier: DataFrame) -> DataFrame:
    """The states at a leaf, and those whose node has an edge for their word's next character."""
    return frontier.where(F.col("node").isNull() | F.expr("instr(nexts, substring(spelt, place + 1, 1)) > 0")).drop("nexts")


def _rest(at: Column) -> Column:
    """What a state's word holds from the place ``at`` (from 0) on."""
    return F.substring("spelt", at + 1, F.length("spelt"))


def pairs_apart_by_one(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of ``words`` (word, n), both ways: the words that one inserted, deleted or replaced code point parts.

    Words are of letters, as ``LETTERS`` has them.
    """
    numbered = stored(words.withColumn("id", F.monotonically_increasing_id()), "words")
    routes = _routes(numbered)
    edges = _edges(routes)
    own = routes.select("backward", "spelt", "n", F.explode("route").alias("at")).select("backward", "spelt", "n", F.col("at.depth").alias("parted"), F.col("at.node").alias("node"), F.substring("spelt", F.col("at.depth") + 1, F.lit(1)).alias("own"))
    own = own.where(F.col("own") != END)
    opened = own.join(edges, ["backward", "node"]).where(F.col("first") != F.col("own"))
    place = F.col("parted") + F.length("label")
    replaced = F.when((F.col("first") > F.col("own")) & _leads(F.concat("first", _rest(F.col("parted") + 1))), place)
    left_out = F.when(_leads(_rest(F.col("parted") + 1)), place + 1)
    state = ["backward", "spelt", "n", "parted", "place", "node"]
    ends = ["leaf", "leaf_n", "nexts"]
    frontier = stored(_goes_on(opened.select("backward", "spelt", "n", "parted", F.explode(F.array_compact(F.array(replaced, left_out))).alias("place"), F.col("child").alias("node"), *ends)), "frontier")
    done = frontier.where("node is null")
    while not frontier.where("node is not null").isEmpty():
        step = frontier.where("node is not null").select(*state).withColumn("first", F.substring("spelt", F.col("place") + 1, F.lit(1)))
        met = step.join(edges, ["backward", "node", "first"]).where(_leads(_rest(F.col("place"))))
        frontier = stored(_goes_on(met.select("backward", "spelt", "n", "parted", (F.col("place") + F.length("label")).alias("place"), F.col("child").alias("node"), *ends)), "frontier")
        done = done.unionByName(frontier.where("node is null"))
    # Nodes are named by hashes: the words must agree up to where they part.
    sure = done.where((F.col("place") == F.length("spelt")) & F.startswith("leaf", F.substring("spelt", F.lit(1), F.col("parted"))))
    plain = lambda c: F.when(F.col("backward"), F.reverse(F.rtrim(F.col(c), F.lit(END)))).otherwise(F.rtrim(F.col(c), F.lit(END)))
    one = stored(sure.select(plain("spelt").alias("word"), "n", plain("leaf").alias("other"), F.col("leaf_n").alias("other_n")).distinct(), "near")
    return one.unionByName(one.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: where the chain of forms ends, by doubling steps."""
    hops = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        met = stored(hops.join(further, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        hops = met.select("word", "root")
        if met.where("moved").isEmpty():
            return hops


def grouped(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root): the words of ``docs`` (doc_id, text), their neighbours counted and the commoner spelling that each goes by.

    Null and empty texts have no words; a null doc_id counts as an empty one in
    the checksum; every row counts, repeated ones too; long runs are whole
    words.  Of neighbours with equal counts the smaller in code-point order is
    the form.  Extra columns are ignored; without words there are no rows.
    """
    words = stored(vocabulary(docs), "vocabulary")
    near = pairs_apart_by_one(words)
    commoner = F.when(F.col("other_n") >= RATIO * F.col("n"), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    found = stored(near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(commoner).alias("best")), "found")
    forms = stored(found.where("best is not null").select("word", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "forms")
    met = words.join(found.select("word", "n_near"), "word", "left").join(forms.join(_roots(forms), "word"), "word", "left")
    return met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


_CHECKSUM_STEP = 3_988_292_384  # the reversed polynomial of CRC-32, a fixed value

SQL = f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_CHECKSUM_STEP}) ELSE c >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
found AS (SELECT doc_id, run, count(*) AS times FROM (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents) WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run),
hexed AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM found),
summed AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p, 2))::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h FROM hexed, steps),
cut AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM summed),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT a.word, b.word AS other FROM less a JOIN words b ON a.rest = b.word),
near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION ALL SELECT word, other FROM shorter UNION ALL SELECT other, word FROM shorter),
met AS (SELECT near.word, other, w.n AS n, o.n AS other_n FROM near JOIN words w ON w.word = near.word JOIN words o ON o.word = other),
counted AS (SELECT word, count(*) AS n_near FROM met GROUP BY word),
best AS MATERIALIZED (SELECT word, other AS form, other_n AS form_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM met WHERE other_n >= {RATIO} * n) WHERE r = 1),
chain(word, reached, step) AS (SELECT word, form, 1 FROM best UNION ALL SELECT chain.word, best.form, step + 1 FROM chain JOIN best ON chain.reached = best.word),
ends AS (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word)
SELECT words.word, words.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form, form_n, coalesce(root, words.word) AS root
FROM words LEFT JOIN counted USING (word) LEFT JOIN best USING (word) LEFT JOIN ends USING (word)
"""
