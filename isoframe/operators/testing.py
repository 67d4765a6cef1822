"""Many p-values at once: Holm and Benjamini-Hochberg without a single global sort.

Ranks over the whole family come from counts per distinct p-value: the windows run over
ranges of values, and only one number per range meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, p: str, ranges: int) -> DataFrame:
    """Distinct p-values with their count, the number of smaller ones, and the size of the family."""
    values = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    # Ranges of about equal numbers of values; any bounds give the same result.
    bounds = values.agg(F.percentile_approx("_p", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    cut = F.size(F.filter(F.lit(sorted(set(bounds))).cast("array<double>"), lambda b: b <= F.col("_p")))
    values = values.withColumn("_range", cut)
    sums = values.groupBy("_range").agg(F.sum("_n").alias("_in_range"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_in_range").over(before), F.lit(0)).alias("_before"), F.sum("_in_range").over(Window.partitionBy(F.lit(0))).alias("_m"))
    inside = Window.partitionBy("_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return values.join(F.broadcast(sums), "_range").withColumn("_less", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))


def holm(df: DataFrame, p: str = "p", ranges: int = 200) -> DataFrame:
    """Add holm: the Holm-adjusted p-value; null where p is null. Ties share a value."""
    ranked = _ranked(df, p, ranges).withColumn("_own", F.least(F.lit(1.0), F.col("_p") * (F.col("_m") - F.col("_less"))))
    tops = ranked.groupBy("_range").agg(F.max("_own").alias("_top"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_range", F.max("_top").over(before).alias("_earlier"))
    inside = Window.partitionBy("_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    adjusted = ranked.join(F.broadcast(tops), "_range").select("_p", F.greatest(F.max("_own").over(inside), F.coalesce("_earlier", F.lit(0.0))).alias("holm"))
    return df.join(adjusted, df[p] == adjusted["_p"], "left").drop("_p")


def benjamini_hochberg(df: DataFrame, alpha: float = 0.05, p: str = "p", ranges: int = 200) -> DataFrame:
    """Add survives: whether the row is among the discoveries at rate alpha; null p-values are not.

    The largest passing p-value is one number, fetched before the rows are marked.
    """
    ranked = _ranked(df, p, ranges)
    passes: Column = F.col("_p") <= alpha * (F.col("_less") + F.col("_n")) / F.col("_m")
    largest = ranked.agg(F.max(F.when(passes, F.col("_p")))).first()[0]
    return df.withColumn("survives", F.coalesce(F.col(p) <= F.lit(largest).cast("double"), F.lit(False)))
