"""Cohort views: breadth over lineages, prevalence, composition, queues, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def generalizability(df: DataFrame, least: int = 2) -> DataFrame:
    """Known lineages per drug; blank and unknown ones do not count."""
    known = F.nullif(F.nullif(F.trim("lineage"), F.lit("")), F.lit("unknown"))
    out = df.groupBy("drug").agg(F.count_distinct(known).alias("n_lineages"), F.array_join(F.sort_array(F.collect_set(known)), ",").alias("lineages"))
    return out.withColumn("generalizable", F.col("n_lineages") >= least)


def prevalence(df: DataFrame, levels: list[str]) -> DataFrame:
    """Tested and resistant rows at every level of a rollup; the rate is null where nothing was tested."""
    tested = F.col("phenotype").isin("R", "S")
    out = df.rollup(*levels).agg(F.count(F.when(tested, 1)).alias("n_tested"), F.count(F.when(F.col("phenotype") == "R", 1)).alias("n_resistant"), F.grouping_id().alias("level"))
    return out.withColumn("rate", F.try_divide(F.col("n_resistant").cast("double"), F.col("n_tested"))).withColumn("level", F.col("level").cast("int"))


def composition(df: DataFrame, by: str, part: str) -> DataFrame:
    """Share of each part within a key."""
    counts = df.groupBy(by, part).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows that depend on their keys and the seed alone, in whatever order the rows come."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def validation_queue(scan: DataFrame, n: int = 50) -> DataFrame:
    """The n strongest findings that were tested: discoveries first, then by size of the effect, then by name."""
    tested = scan.where(F.col("verdict").isin("evidence-of-effect", "no-evidence") & F.col("delta").isNotNull())
    return tested.orderBy(F.col("survives").desc(), F.abs("delta").desc_nulls_last(), "pair_id").limit(n)


def with_truth(predictions: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with their truth; those without one are kept with the reason."""
    joined = predictions.join(truths.select(*keys, "truth"), keys, "left")
    return joined.withColumn("dropped", F.when(F.col("truth").isNull(), "no truth"))
