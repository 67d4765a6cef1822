"""Risk against coverage of predictions that may abstain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.operators.joins import null_safe
from isoframe.operators.running import running_sums


def curve(df: DataFrame, steps: int = 50, min_covered: int = 10, ranges: int = 64) -> DataFrame:
    """Per drug: a point for the lowest, each strided and the highest confidence level.

    Rows are first counted per confidence level, and the levels of a drug are cut into
    ranges that are summed apart (see ``running.running_sums``).
    A row without a call or without a confidence is never answered but counts in the total.
    """
    answered = F.col("predicted").isNotNull() & F.col("confidence").isNotNull()
    wrong = answered & ~F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False))
    levels = df.withColumn("_level", F.when(answered, F.col("confidence"))).groupBy("drug", "_level").agg(
        F.count("*").alias("_n"), F.count(F.when(wrong, 1)).alias("_wrong")
    )
    totals = levels.groupBy("drug").agg(F.sum("_n").alias("n_total"))
    held = levels.where("_level IS NOT NULL").withColumn("_one", F.lit(1))
    ranked = null_safe(running_sums(held, ["drug"], "_level", ["_n", "_wrong", "_one"], ranges), totals, ["drug"])
    ranked = ranked.withColumns({"n_covered": F.col("_n_total") - F.col("_n_before"), "n_errors": F.col("_wrong_total") - F.col("_wrong_before"), "_place": F.col("_one_before"), "_levels": F.col("_one_total")})
    stride = F.greatest(F.lit(1), F.floor(F.col("_levels") / max(1, steps - 1)))
    kept = ranked.where((F.col("_place") % stride == 0) | (F.col("_place") == F.col("_levels") - 1))
    return kept.select(
        "drug", F.col("_level").alias("threshold"), "n_total", "n_covered", "n_errors", (F.col("n_covered") / F.col("n_total")).alias("coverage"),
        F.when(F.col("n_covered") >= min_covered, F.col("n_errors") / F.col("n_covered")).alias("risk"),
    )


def area(points: DataFrame) -> DataFrame:
    """Mean risk over coverage per drug (trapezoids); null with fewer than two usable points."""
    order = Window.partitionBy("drug").orderBy("coverage")
    steps = points.where("risk IS NOT NULL").withColumns({"_c": F.lead("coverage").over(order), "_r": F.lead("risk").over(order)})
    width = F.col("_c") - F.col("coverage")
    return steps.groupBy("drug").agg(
        F.try_divide(F.sum(F.when(width > 0, width * (F.col("risk") + F.col("_r")) / 2)), F.sum(F.when(width > 0, width))).alias("area")
    )


def against_baseline(points: DataFrame, baselines: DataFrame, margin: float = 0.0) -> DataFrame:
    """Each drug's point of least coverage that still reaches the baseline's, and which does better.

    A point with too few answers for a risk leaves the comparison underpowered.
    """
    usable: Column = F.col("coverage") >= F.col("base_coverage")
    joined = baselines.join(points, "drug", "left")
    out = joined.groupBy("drug", "base_coverage", "base_risk").agg(F.min_by("risk", F.when(usable, F.col("coverage"))).alias("risk"), F.min(F.when(usable, F.col("coverage"))).alias("coverage"))
    verdict = F.when(F.col("coverage").isNull(), "cannot-match-coverage").when(F.col("risk").isNull(), "underpowered").when(F.col("risk") + margin < F.col("base_risk"), "beats-baseline")
    return out.withColumn("risk", F.when(F.col("coverage").isNotNull(), F.col("risk"))).withColumn("verdict", verdict.otherwise("no-better-than-baseline"))
