"""Prefix tables (tries), successor cuts and morphological signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import kept

NULL_SUFFIX = "NULL"
STATES = 50_000
"""Rows of states that leave Python together."""


def prefixes(dist: DataFrame, reverse: bool = False) -> DataFrame:
    """(prefix, depth, f, words): each prefix, the empty one too, with the weight and number of the words below it; of suffixes with ``reverse``."""
    w = F.reverse("w") if reverse else F.col("w")
    each = dist.select("f", w.alias("w")).select("f", "w", F.explode(F.sequence(F.lit(0), F.length("w"))).alias("depth"))
    return each.groupBy(F.substring("w", F.lit(1), F.col("depth")).alias("prefix"), F.col("depth").cast("long").alias("depth")).agg(F.sum("f").alias("f"), F.count("*").alias("words"))


def widths(words: DataFrame) -> DataFrame:
    """(prefix, width): how many different characters follow each prefix of the different words (w)."""
    each = words.select("w", F.explode(F.sequence(F.lit(0), F.length("w") - 1)).alias("depth")).select(F.substring("w", F.lit(1), F.col("depth")).alias("prefix"), F.substring("w", F.col("depth") + 1, F.lit(1)).alias("next"))
    return each.distinct().groupBy("prefix").agg(F.count("*").alias("width"))


def splits(words: DataFrame) -> DataFrame:
    """(stem, suffix, w): every cut of every word into two parts, empty ones too."""
    return words.select("w", F.explode(F.sequence(F.lit(0), F.length("w"))).alias("k")).select(F.substring("w", F.lit(1), F.col("k")).alias("stem"), F.expr("substring(w, k + 1)").alias("suffix"), "w")


def successor_cuts(words: DataFrame, least_stem: int = 3, most_affix: int = 5) -> DataFrame:
    """(w, cut): the last place, in characters, where several characters may follow but only one before and after it.

    The stem has ``least_stem`` characters or more, what is cut off
    ``most_affix`` or fewer.
    """
    inner = F.sequence(F.lit(1), F.length("w"))
    each = words.where(F.length("w") > least_stem).select("w", F.explode(inner).alias("pos")).withColumn("prefix", F.substring("w", F.lit(1), F.col("pos")))
    seen = each.join(widths(words), "prefix", "left").select("w", "pos", F.coalesce("width", F.lit(0)).alias("width"))
    order = Window.partitionBy("w").orderBy("pos")
    near = seen.withColumns({"before": F.lag("width").over(order), "after": F.lead("width").over(order)})
    good = near.where((F.col("before") <= 1) & (F.col("width") > 1) & (F.col("after") <= 1) & (F.col("pos") >= least_stem) & (F.length("w") - F.col("pos") <= most_affix))
    return good.groupBy("w").agg(F.max("pos").cast("long").alias("cut"))


def signatures(words: DataFrame, cuts: DataFrame) -> DataFrame:
    """(stem, signature, suffixes): each stem's suffixes in order; a word that is itself a stem gives the null suffix."""
    cut = cuts.select(F.expr("substring(w, 1, cut)").alias("stem"), F.expr("substring(w, cut + 1)").alias("suffix"))
    plain = words.join(cut.select(F.col("stem").alias("w")).distinct(), "w", "left_semi").select(F.col("w").alias("stem"), F.lit(NULL_SUFFIX).alias("suffix"))
    return cut.unionByName(plain).groupBy("stem").agg(F.sort_array(F.collect_set("suffix")).alias("s")).select("stem", F.array_join("s", ",").alias("signature"), F.size("s").cast("long").alias("suffixes"))


def signature_model(stems: DataFrame, least: int = 1) -> DataFrame:
    """(signature, stems, robustness): how many stems share a signature, and the letters that it saves, in bits for 26 letters."""
    letters = F.length(F.regexp_replace("signature", ",|NULL", "")) / F.col("suffixes")
    bits = F.log2(F.lit(26.0)) * (F.avg(F.length("stem")) * (F.max("suffixes") - 1) + F.max(letters) * (F.count("*") - 1))
    return stems.groupBy("signature").agg(F.count("*").alias("stems"), bits.alias("robustness")).where(F.col("stems") >= least)


def _regrouped(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("stem").agg(F.sort_array(F.collect_set("suffix")).alias("s")).select("stem", F.array_join("s", ",").alias("signature"), F.size("s").cast("long").alias("suffixes"))


def without_rare_suffixes(stems: DataFrame, least: int = 3) -> DataFrame:
    """The table (stem, signature, suffixes) without suffixes that fewer than ``least`` stems have; stems that have none left go."""
    pairs = stems.select("stem", F.explode(F.split("signature", ",")).alias("suffix"))
    common = pairs.groupBy("suffix").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("suffix")
    return _regrouped(pairs.join(common, "suffix"))


def without_doubtful_signatures(stems: DataFrame, large: int = 25, long: int = 2, many: int = 2) -> DataFrame:
    """The table without the stems of signatures that fewer than ``large`` stems share, unless ``many`` of their suffixes are null or of ``long`` letters or more."""
    suffixes = F.split("signature", ",")
    sound = F.size(F.filter(suffixes, lambda f: (f == NULL_SUFFIX) | (F.length(f) >= long))) >= many
    sizes = stems.groupBy("signature").agg(F.count("*").alias("n"))
    good = sizes.where((F.col("n") >= large) | sound).select("signature")
    return stems.join(good, "signature").select("stem", "signature", "suffixes")


def acceptor(unigrams: DataFrame, edge: str, reverse: bool = False) -> DataFrame:
    """(source, label, target, f): the arcs of the prefix (or suffix) acceptor of the words, an edge mark on either side; a state is the text that leads to it."""
    word = F.reverse("w") if reverse else F.col("w")
    each = unigrams.select(word.alias("w"), "f").select("w", "f", F.explode(F.sequence(F.lit(0), F.length("w") + 1)).alias("k"))
    n = F.length("w")
    source = F.when(F.col("k") == 0, F.lit("")).otherwise(F.concat(F.lit(edge), F.expr("substring(w, 1, k - 1)")))
    label = F.when((F.col("k") == 0) | (F.col("k") > n), F.lit(edge)).otherwise(F.expr("substring(w, k, 1)"))
    arcs = each.select(source.alias("source"), label.alias("label"), F.concat(source, label).alias("target"), "f")
    return arcs.groupBy("source", "label", "target").agg(F.sum("f").alias("f"))


def sentence_acceptor(sents: DataFrame, keys: list[str], edge: str, reverse: bool = False) -> DataFrame:
    """(depth, first, label, f): the arcs of the prefix (or suffix) tree acceptor of sentences (keys…, toks), an edge mark on either side.

    A state is what has been read so far.  It is named by its ``depth`` and
    ``first``, the least key of the sentences that reach it, and found by two
    hashes of all labels with their places, so a sentence costs as many rows as
    it has words, however long.
    """
    toks = F.concat(F.array(F.lit(edge)), F.reverse("toks") if reverse else F.col("toks"), F.array(F.lit(edge)))
    places = [F.transform("labels", _placed(salt)).alias(f"h{salt}") for salt in (1, 2)]
    each = sents.select(F.struct(*keys).alias("key"), toks.alias("labels")).select("key", "labels", *places)
    kind = each.schema["key"].dataType.simpleString()
    states = each.mapInArrow(_states, f"key {kind}, depth int, label string, h1 long, h2 long")
    arcs = kept(states.groupBy("depth", "h1", "h2", "label").agg(F.count("*").alias("f"), F.min("key").alias("first")), "arcs")
    # Only a state that several labels leave may have a lesser key than its arc has.
    several = kept(arcs.groupBy("depth", "h1", "h2").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "names")
    met = arcs.join(several, ["depth", "h1", "h2"], "left")
    return met.select("depth", F.coalesce("least", "first").alias("first"), "label", "f")


def _placed(salt: int) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.xxhash64(i, x, F.lit(salt))


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each label of rows (key, labels, h1, h2): its place, and the hashes of all places before it, combined."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch["labels"].offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        parent = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        hashes = []
        for name in ("h1", "h2"):
            before = np.concatenate([[0], np.bitwise_xor.accumulate(batch[name].flatten().to_numpy())])
            hashes.append(pa.array(before[:-1] ^ before[starts[parent]]))
        depth = pa.array((np.arange(len(parent)) - starts[parent]).astype(np.int32))
        columns = [None, depth, batch["labels"].flatten(), *hashes]
        for lo in range(0, len(parent), STATES):
            part = [c.slice(lo, STATES) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(parent[lo : lo + STATES])), *part], names=["key", "depth", "label", "h1", "h2"])
