"""Affix stripping, and trees of nodes and parents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import kept


def stemmed(words: DataFrame, prefixes: list[str], suffixes: list[str], exceptions: DataFrame | None = None) -> DataFrame:
    """(w, parse): prefixes stripped from the left as long as one fits, the longest first, then suffixes from the right; parts are joined by dots.

    Exceptions (w, parse) win. A word keeps at least one letter as its stem.
    """

    def longest(parts: list[str]) -> str:
        return "|".join(re.escape(p) for p in sorted(parts, key=lambda p: (-len(p), p))) or r"(?!)"

    front, back = longest(prefixes), longest([s[::-1] for s in suffixes])
    head = F.regexp_extract("w", f"^(?:(?:{front})(?=.))*", 0)
    rest = F.expr("substring(w, length(_head) + 1)")
    tail = F.reverse(F.regexp_extract(F.reverse("_rest"), f"^(?:(?:{back})(?=.))*", 0))
    cut = words.select("w").withColumn("_head", head).withColumn("_rest", rest).withColumn("_tail", tail)
    stem = F.expr("substring(_rest, 1, length(_rest) - length(_tail))")
    before = F.regexp_extract_all("_head", F.lit(f"({front})"), F.lit(1))
    after = F.reverse(F.transform(F.regexp_extract_all(F.reverse("_tail"), F.lit(f"({back})"), F.lit(1)), lambda x: F.reverse(x)))
    parsed = cut.select("w", F.array_join(F.concat(before, F.array(stem), after), ".").alias("parse"))
    if exceptions is None:
        return parsed
    return parsed.join(exceptions.select("w", F.col("parse").alias("_e")), "w", "left").select("w", F.coalesce("_e", "parse").alias("parse"))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(node, root, depth, path) of a table (node, parent): from each root, whose parent is null, downwards.

    The way up that is known of a node gets twice as long with each round, a join
    with the ways of the nodes reached so far.  Nodes of depth 1, then 2 and 3, then
    4 to 7 and so on get to their root, so a round in which none does is the last:
    what is left hangs from no root.
    """
    own = nodes.select("node", F.col("parent").alias("up"), F.col("node").cast("string").alias("path"))
    done = kept(own.where("up is null").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), "path"), "paths")
    # ``up`` is the node above the path, ``steps`` what lies between it and the node.
    open_ = kept(own.where("up is not null").withColumn("steps", F.lit(1).cast("long")), "paths")
    found = [done]
    while True:
        reached = None
        for part in found:
            reached = part if reached is None else reached.unionByName(part)
        above = reached.select(F.col("node").alias("up"), "root", F.col("depth").alias("_steps"), F.col("path").alias("_path"))
        new = kept(open_.join(above, "up").select("node", "root", (F.col("steps") + F.col("_steps")).alias("depth"), F.concat("_path", F.lit("/"), "path").alias("path")), "paths")
        if new.isEmpty():
            return reached
        further = open_.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("path").alias("_path"))
        open_ = kept(open_.join(further, "up").select("node", F.col("_up").alias("up"), F.concat("_path", F.lit("/"), "path").alias("path"), (F.col("steps") + F.col("_steps")).alias("steps")), "paths")
        found.append(new)


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without daughters."""
    return nodes.join(nodes.select(F.col("parent").alias("node")).where("node is not null"), "node", "left_anti")
