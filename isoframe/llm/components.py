"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoframe.llm.common import written


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node.

    Each round rewires edges towards smaller neighbours and writes the table, so lineage
    stays short and nothing but two sums per round reaches the driver.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = written(now, "edges")
    before = state(now)
    of_a = Window.partitionBy("a")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.withColumn("_m", F.least(F.min("b").over(of_a), F.col("a"))).where("b > a")
            .select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()
        )
        least = large.withColumn("_m", F.min("b").over(of_a))
        small = (
            least.select(F.col("b").alias("a"), F.col("_m").alias("b"))
            .unionByName(least.select("a", F.col("_m").alias("b"))).where("a <> b").distinct()
        )
        now = written(small, "edges")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
