"""Sentences, tokens, n-grams, contexts and token filters of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = "__$"
"""Stands before the first and after the last token of a sentence."""
UNKNOWN = "@UNKNOWN"
WORD = r"[\p{L}\p{M}\p{N}]+"
"""A word: a run of letters, marks and digits of any script."""


def sentences(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """(…, sid, toks): each line with a word is a sentence; its words are taken from the lower-cased line."""
    lines = docs.select(*keep, F.posexplode(F.split("text", "\n")).alias("sid", "line"))
    return lines.select(*keep, (F.col("sid") + 1).cast("long").alias("sid"), F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0)).alias("toks")).where(F.size("toks") > 0)


def tokens(sents: DataFrame) -> DataFrame:
    """A row (…, sid, pos, w) for each token, pos from 1."""
    others = [c for c in sents.columns if c != "toks"]
    return sents.select(*others, F.posexplode("toks").alias("pos", "w")).withColumn("pos", (F.col("pos") + 1).cast("long"))


def padded(toks: Column | str, left: int, right: int) -> Column:
    edge = lambda n: F.array_repeat(F.lit(EDGE), n)
    return F.concat(edge(left), F.col(toks) if isinstance(toks, str) else toks, edge(right))


def windows(toks: Column, n: int) -> Column:
    """All runs of n neighbours of an array, as structs w1..wn; none, where it has fewer than n items.

    They are n slices side by side, so that an array that is itself made by an expression is made n times, not once for each run.
    """
    many = F.greatest(F.size(toks) - (n - 1), F.lit(0))
    kind = ",".join(f"w{j + 1}:string" for j in range(n))
    return F.arrays_zip(*[F.slice(toks, j + 1, many) for j in range(n)]).cast(f"array<struct<{kind}>>")


def ngram_counts(sents: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, w1..wn, f): n-grams within sentences, padded with n-1 edge marks on either side."""
    grams = sents.withColumn("_p", padded("toks", n - 1, n - 1)).select(*by, F.explode(windows(F.col("_p"), n)).alias("g")).select(*by, "g.*")
    return grams.groupBy(*by, *[f"w{i + 1}" for i in range(n)]).agg(F.count("*").alias("f"))


def positional_counts(sents: DataFrame, width: int) -> DataFrame:
    """(step, w, c, f): how often c stands ``step`` tokens after w, for each step up to ``width``."""
    each = sents.select("toks", F.posexplode("toks").alias("i", "w"))
    after = F.array(*[F.get("toks", F.col("i") + j) for j in range(1, width + 1)])
    pairs = each.select("w", F.posexplode(after).alias("step", "c")).where("c is not null")
    return pairs.groupBy((F.col("step") + 1).cast("long").alias("step"), "w", "c").agg(F.count("*").alias("f"))


def activation(sents: DataFrame, targets: DataFrame, bounds: DataFrame, width: int, decay: float) -> DataFrame:
    """(dir, t, b, f): co-occurrence up to ``width`` tokens away, each place at distance j weighing j^-decay.

    Sentences are padded with ``width`` edge marks; ``targets`` and ``bounds``
    are dictionaries (w) of a bounded size.
    """
    p = sents.withColumn("p", padded("toks", width, width))
    at = p.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i"))
    t = F.get("p", F.col("i") - 1)
    steps = [F.struct(F.lit(d).alias("dir"), F.lit(j).alias("j"), F.get("p", F.col("i") - 1 + (j if d == "right" else -j)).alias("b")) for d in ("left", "right") for j in range(1, width + 1)]
    near = at.select(t.alias("t"), "p", "i").join(F.broadcast(targets.select(F.col("w").alias("t"))), "t").select("t", F.explode(F.array(*[F.when(F.col("i") + (s_j if right else -s_j) > 0, s) for s, s_j, right in zip(steps, [*range(1, width + 1)] * 2, [False] * width + [True] * width, strict=True)])).alias("x"))
    near = near.where(F.col("x").isNotNull()).select("x.dir", "x.j", "t", "x.b").where("b is not null")
    return near.join(F.broadcast(bounds.select(F.col("w").alias("b"))), "b").groupBy("dir", "t", "b").agg(F.sum(F.pow(F.col("j").cast("double"), F.lit(-decay))).alias("f"))


def nearest_bounds(sents: DataFrame, bounds: DataFrame) -> DataFrame:
    """(dir, t, b, f): each token with the last bound before it and the first one after it; edges are bounds."""
    keys = [c for c in sents.columns if c != "toks"]
    toks = sents.withColumn("toks", padded("toks", 1, 1)).select(*keys, F.posexplode("toks").alias("pos", "w"))
    known = F.broadcast(bounds.select(F.col("w"), F.col("w").alias("b")).unionByName(bounds.sparkSession.createDataFrame([(EDGE, EDGE)], "w string, b string")).dropDuplicates(["w"]))
    marked = toks.join(known, "w", "left")
    order = Window.partitionBy(*keys).orderBy("pos")
    before = F.last("b", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("b", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    seen = marked.select("w", before.alias("l"), after.alias("r")).where(F.col("w") != EDGE)
    sides = seen.select(F.explode(F.array(F.struct(F.lit("left").alias("dir"), F.col("l").alias("b")), F.struct(F.lit("right").alias("dir"), F.col("r").alias("b")))).alias("x"), "w")
    return sides.select("x.dir", F.col("w").alias("t"), "x.b").groupBy("dir", "t", "b").agg(F.count("*").alias("f"))


def keep_known(toks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tokens whose word the vocabulary (w) holds."""
    return toks.join(vocabulary.select("w"), "w", "left_semi")


def keep_known_trigrams(toks: DataFrame, trigrams: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens whose word and two before it (edge marks before the first) are in ``trigrams`` (w1, w2, w3)."""
    order = Window.partitionBy(*keys).orderBy("pos")
    seen = toks.withColumns({"w1": F.coalesce(F.lag("w", 2).over(order), F.lit(EDGE)), "w2": F.coalesce(F.lag("w", 1).over(order), F.lit(EDGE)), "w3": F.col("w")})
    return seen.join(trigrams.select("w1", "w2", "w3"), ["w1", "w2", "w3"], "left_semi").drop("w1", "w2", "w3")


def safe_sentences(sents: DataFrame, tags: str, unsafe: tuple[str, ...] = ("NIL", "nil", "")) -> DataFrame:
    """Sentences none of whose tags (an array column) is missing or unsafe."""
    return sents.where(~F.exists(tags, lambda t: t.isNull() | t.isin(*unsafe)))


def mapped(rows: DataFrame, mapping: DataFrame, source: str, to: str, unknown: str | None = UNKNOWN) -> DataFrame:
    """``to`` set to the mapping (k, v) of ``source``; what is not mapped gets ``unknown``, or stays if that is None."""
    old = F.col(source) if unknown is None else F.lit(unknown)
    return rows.join(mapping.select(F.col("k").alias(source), F.col("v").alias("_v")), source, "left").withColumn(to, F.coalesce("_v", old)).drop("_v")


def as_tagged(sents: DataFrame, separator: str = "/", tag: str = "lang") -> DataFrame:
    """Sentences as lines of ``text<separator>tag`` tokens."""
    return sents.select(*[c for c in sents.columns if c != "toks"], F.array_join(F.transform("toks", lambda t: F.concat(t, F.lit(separator), F.col(tag))), " ").alias("line"))
