"""Paired workflow comparison, submission checks and the closing of an effect scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoframe.operators.resampling import quantiles
from isoframe.operators.testing import benjamini_hochberg, holm


def paired_change(df: DataFrame, measures: list[str], split: dict[str, str] | None = None) -> DataFrame:
    """Mean and median change of each measure over rows that have it before and after.

    ``split`` names a column by which a measure is kept apart (costs by currency). A
    measure without a complete pair has no row: nothing measured is not a change of 0.
    """
    split = split or {}
    unit = lambda m: F.coalesce(F.col(split[m]), F.lit("")) if m in split else F.lit("native_unit")
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), unit(m).alias("unit"), (F.col(f"intervention_{m}") - F.col(f"baseline_{m}")).cast("double").alias("change")) for m in measures])
    long = df.select(F.explode(cells).alias("c")).select("c.*").where("change IS NOT NULL")
    means = long.groupBy("measure", "unit").agg(F.count("*").alias("n_pairs"), F.avg("change").alias("mean_change"))
    return means.join(quantiles(long, ["measure", "unit"], "change", 0.5).withColumnRenamed("quantile", "median_change").drop("n").hint("merge"), ["measure", "unit"])


def checked_submissions(df: DataFrame, max_age_hours: int = 24, future_hours: int = 1) -> DataFrame:
    """Add reject_reason: replayed (a nonce accepted before), stale, or future.

    ``df`` has nonce, sent and received. Only submissions that are fresh use up a nonce,
    in order of receipt.
    """
    age = F.unix_micros(F.col("received").cast("timestamp")) - F.unix_micros(F.col("sent").cast("timestamp"))
    hour = 3_600_000_000
    stale = F.when(age > max_age_hours * hour, "stale").when(age < -future_hours * hour, "future")
    order = Window.partitionBy("nonce").orderBy("received", "submission_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.when(F.col("_late").isNull(), 1).otherwise(0)).over(order), F.lit(0))
    return df.withColumn("_late", stale).withColumn("reject_reason", F.when(earlier > 0, "replayed").otherwise(F.col("_late"))).drop("_late")


def finalised(scan: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Both corrections over the whole family; an effect whose adjusted p exceeds alpha is demoted."""
    both = benjamini_hochberg(holm(scan), alpha)
    demoted = (F.col("verdict") == "evidence-of-effect") & (F.col("holm") > alpha)
    return both.withColumn("verdict", F.when(F.coalesce(demoted, F.lit(False)), "no-evidence").otherwise(F.col("verdict")))
