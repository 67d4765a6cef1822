"""Connected components of a graph that is given as rows of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected(edges: DataFrame, store: Callable[[DataFrame, str], DataFrame], rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node of the component.

    Every node holds a parent that is not larger than itself. A round gives each root the
    smallest parent that an edge shows next to its tree, then lets every node skip to its
    parent's parent until trees are flat. Trees merge in pairs at least, so rounds grow
    with the logarithm of the number of nodes. Tables are written (``store``); a count of
    changes is all that comes to the driver. Null ends are left out; an empty table gives
    no rows.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = store(ends.select("a", "b").unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    alone = edges.where("a IS NOT NULL AND a = b").select(F.col("a").alias("node")).distinct()
    parents = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "parents")
    for _ in range(rounds):
        parents = flattened(parents, store, rounds)
        a = parents.select(F.col("node").alias("a"), F.col("root").alias("_x"))
        b = parents.select(F.col("node").alias("b"), F.col("root").alias("_y"))
        seen = both.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("_x > _y")
        offers = store(seen.groupBy(F.col("_x").alias("node")).agg(F.min("_y").alias("_offer")), "offers")
        if offers.isEmpty():
            return parents.unionByName(alone.join(parents.select("node").hint("merge"), "node", "left_anti").select("node", F.col("node").alias("root")))
        parents = store(parents.join(offers.hint("merge"), "node", "left").select("node", F.coalesce("_offer", "root").alias("root")), "parents")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def flattened(parents: DataFrame, store: Callable[[DataFrame, str], DataFrame], rounds: int = 60) -> DataFrame:
    """Every node with the root at the end of its parents, by pointer doubling: the path to it halves with each round."""
    for _ in range(rounds):
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        next_ = store(parents.join(up.hint("merge"), "root", "left").select("node", "root", F.coalesce("_up", "root").alias("_up")), "parents")
        parents = next_.select("node", F.col("_up").alias("root"))
        if next_.where("_up <> root").isEmpty():
            return parents
    raise RuntimeError(f"parents did not settle in {rounds} rounds")
