"""Trees as numbers: pre-order and post-order places, depths and sizes of a table (node, parent) of any depth.

An Euler tour enters and leaves every node once.  It is a list whose items
know the next one, and pointer jumping, which doubles the reach of each item by a
join a round, gives each its distance from the end.  Ancestors, descendants and order
are then comparisons of two numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import kept
from .dictionary import indexed


def _tour(nodes: DataFrame) -> DataFrame:
    """(node, leaves, to, to_leaves): each step of the tour, entering or leaving a node, and the step after it (null at the end); siblings in the order of their names."""
    first = nodes.where("parent is not null").groupBy("parent").agg(F.min("node").alias("child"))
    placed = kept(indexed(nodes.select("node", "parent"), [F.col("parent").asc_nulls_first(), F.col("node")], "place"), "placed")
    after = placed.select((F.col("place") - 1).alias("place"), F.col("node").alias("next"), F.col("parent").alias("of"))
    beside = placed.join(after, "place", "left").select("node", "parent", F.when(F.col("of").eqNullSafe(F.col("parent")), F.col("next")).alias("next"))
    enter = nodes.select("node").join(first.withColumnRenamed("parent", "node"), "node", "left").select("node", F.lit(False).alias("leaves"), F.coalesce("child", "node").alias("to"), F.col("child").isNull().alias("to_leaves"))
    leave = beside.select("node", F.lit(True).alias("leaves"), F.coalesce("next", "parent").alias("to"), F.when(F.coalesce("next", "parent").isNotNull(), F.col("next").isNull()).alias("to_leaves"))
    return enter.unionByName(leave)


def numbered(nodes: DataFrame) -> DataFrame:
    """(node, parent, pre, post, depth, size) of a table (node, parent), in which roots have no parent.

    ``pre`` and ``post`` run from 0 over all trees, roots in the order of their
    names; ``size`` counts a node and all below it.  Nodes are different and
    have at most one parent, which is in the table.
    """
    nodes = kept(nodes.select("node", "parent"), "nodes")
    total = nodes.count()
    step = kept(_tour(nodes).withColumns({"enters": (~F.col("leaves")).cast("long"), "exits": F.col("leaves").cast("long")}), "tour")
    # ``enters`` and ``exits`` count the steps from this one up to, not including, the one it points to.
    while not step.where("to is not null").isEmpty():
        ahead = step.select(F.col("node").alias("to"), F.col("leaves").alias("to_leaves"), F.col("to").alias("on"), F.col("to_leaves").alias("on_leaves"), F.col("enters").alias("more_enters"), F.col("exits").alias("more_exits"))
        met = step.join(ahead, ["to", "to_leaves"], "left")
        step = kept(met.select("node", "leaves", F.col("on").alias("to"), F.col("on_leaves").alias("to_leaves"), (F.col("enters") + F.coalesce("more_enters", F.lit(0))).alias("enters"), (F.col("exits") + F.coalesce("more_exits", F.lit(0))).alias("exits")), "tour")
    of = lambda leaves, name: F.max(F.when(F.col("leaves") == leaves, F.col(name)))
    sums = step.groupBy("node").agg(of(False, "enters").alias("e"), of(False, "exits").alias("x"), of(True, "enters").alias("e2"), of(True, "exits").alias("x2"))
    pre, post = total - F.col("e"), total - F.col("x2")
    return nodes.join(sums, "node").select("node", "parent", pre.alias("pre"), post.alias("post"), (pre - (total - F.col("x"))).alias("depth"), (F.col("e") - F.col("e2")).alias("size"))


def is_ancestor(a: str, b: str) -> Column:
    """Whether the node of the columns ``<a>pre``, ``<a>post`` is above that of ``<b>…``."""
    return (F.col(f"{a}pre") < F.col(f"{b}pre")) & (F.col(f"{a}post") > F.col(f"{b}post"))


def is_leaf() -> Column:
    return F.col("size") == 1


def ancestors(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, ancestor, up): the nodes above each of a stated set (node), ``up`` steps away, nearest first.

    The asked nodes climb one step a round, so a round is a join with the parents.
    """
    now = asked.join(tree.select("node", "parent"), "node").where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("up"))
    out, up = now, 1
    now = kept(now, "climbers")
    while not now.isEmpty():
        up += 1
        now = kept(now.join(tree.select(F.col("node").alias("ancestor"), "parent"), "ancestor").where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(up).alias("up")), "climbers")
        out = out.unionByName(now)
    return out


def common_ancestor(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor): the lowest node that is above or equal to both of a stated set of pairs (a, b); null in different trees."""
    asked = kept(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "asked")
    above = kept(ancestors(tree, asked).select("node", "ancestor").unionByName(asked.select("node", F.col("node").alias("ancestor"))), "above")
    one, two = above.select(F.col("node").alias("a"), "ancestor"), above.select(F.col("node").alias("b"), "ancestor")
    met = pairs.join(one, "a").join(two, ["b", "ancestor"]).join(tree.select(F.col("node").alias("ancestor"), "depth"), "ancestor")
    lowest = met.groupBy("a", "b").agg(F.max_by("ancestor", "depth").alias("ancestor"))
    return pairs.join(lowest, ["a", "b"], "left").select("a", "b", "ancestor")


def bracketed(tree: DataFrame) -> DataFrame:
    """(place, piece): the canonical form of the trees, ``(name`` for entering a node and ``)`` for leaving it, in the order of the places."""
    # Before entering a node the tour has entered ``pre`` nodes and left all of those but its ancestors; before leaving it, all below it.
    enter = tree.select((2 * F.col("pre") - F.col("depth")).alias("place"), F.concat(F.lit("("), F.col("node").cast("string")).alias("piece"))
    leave = tree.select((2 * F.col("post") + F.col("depth") + 1).alias("place"), F.lit(")").alias("piece"))
    return enter.unionByName(leave)
