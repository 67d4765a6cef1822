"""Locus coverage from depth tables, callable regions, per-base depths and threshold counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoframe.operators.coverage import interval_join


def from_depth(rows: DataFrame) -> DataFrame:
    """locus, mean_depth, callable_fraction and error of rows with (optional) callable_fraction, covered_bp and total_bp.

    A given fraction counts, else covered over total, at most 1; without either it is
    unknown, not 0. A fraction outside 0..1 is an error.
    """
    have = lambda c: F.col(c).try_cast("double") if c in rows.columns else F.lit(None).cast("double")
    given = have("callable_fraction")
    made = F.when(have("total_bp") > 0, F.least(F.lit(1.0), have("covered_bp") / have("total_bp")))
    error = F.when((given < 0) | (given > 1), "fraction outside 0..1")
    keys = [c for c in rows.columns if c not in ("mean_depth", "callable_fraction", "covered_bp", "total_bp")]
    return rows.where("trim(locus) <> ''").select(*keys, have("mean_depth").cast("long").alias("mean_depth"), F.when(error.isNull(), F.coalesce(given, made)).alias("callable_fraction"), error.alias("error"))


def _half_even(value: Column) -> Column:
    return F.bround(value).cast("long")


def from_regions(regions: DataFrame, lengths: DataFrame, by: list[str]) -> DataFrame:
    """Per locus: covered bases over its length (unknown length: unknown fraction) and mean depth of its regions.

    ``regions`` has start, end, locus and depth (may be null); an end before its start is an error.
    """
    backwards = F.when(F.col("end") < F.col("start"), F.raise_error(F.lit("region ends before it starts")).cast("long")).otherwise(F.col("end") - F.col("start"))
    sums = regions.groupBy(*by, "locus").agg(F.sum(backwards).alias("_bp"), F.avg("depth").alias("_depth"))
    out = sums.join(lengths.select("locus", "length").hint("merge"), "locus", "left")
    return out.select(*by, "locus", _half_even(F.col("_depth")).alias("mean_depth"), F.when(F.col("length") > 0, F.least(F.lit(1.0), F.col("_bp") / F.col("length"))).alias("callable_fraction"))


def from_positions(depths: DataFrame, spans: DataFrame, by: list[str], floor: int = 10) -> DataFrame:
    """Per locus of ``spans`` (start, end, half open): share of positions at the floor, and mean depth of those given.

    ``depths`` has pos (counted from 0) and depth. Positions meet spans in bins.
    """
    points = depths.select(*by, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "depth")
    pairs = interval_join(points, spans, by)
    sums = pairs.groupBy(*by, F.col("locus_b").alias("locus")).agg(F.count(F.when(F.col("depth_a") >= floor, 1)).alias("_ok"), F.avg("depth_a").alias("_depth"))
    out = spans.select(*by, "locus", F.greatest(F.lit(1), F.col("end") - F.col("start")).alias("_size")).join(sums.hint("merge"), [*by, "locus"], "left")
    return out.select(*by, "locus", _half_even(F.col("_depth")).alias("mean_depth"), F.least(F.lit(1.0), F.coalesce("_ok", F.lit(0)) / F.col("_size")).alias("callable_fraction"))


def from_thresholds(thresholds: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """Per locus of ``thresholds`` (start, end, n_at_floor): share of bases at the floor; the mean depth comes from ``regions`` where it has the locus."""
    means = regions.select(*by, "locus", F.col("mean").alias("_mean"))
    out = thresholds.join(means.hint("merge"), [*by, "locus"], "left")
    size = F.greatest(F.lit(1), F.col("end") - F.col("start"))
    return out.select(*by, "locus", _half_even(F.col("_mean")).alias("mean_depth"), F.least(F.lit(1.0), F.col("n_at_floor") / size).alias("callable_fraction"))
