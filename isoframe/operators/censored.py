"""Measurements with detection limits: parsing, profiles, medians and pairwise shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoframe.operators.joins import null_safe
from isoframe.operators.running import running_sums


def parsed(df: DataFrame, raw: str = "mic") -> DataFrame:
    """Add mic_value and censoring (left, right, none) of a measured text.

    Blank and NA texts have no censoring; a text that is no number keeps a null value.
    """
    t = F.trim(F.col(raw))
    missing = F.coalesce(t, F.lit("")).isin("", "NA")
    side = F.when(missing, F.lit(None)).when(t.startswith("<"), "left").when(t.startswith(">"), "right").otherwise("none")
    number = F.regexp_replace(t, "^[<>]=?\\s*", "").try_cast("double")
    return df.withColumns({"censoring": side, "mic_value": F.when(~missing, number)})


def log2_bounds(df: DataFrame) -> DataFrame:
    """Rows with a positive finite value, as log2_bound."""
    v = F.col("mic_value")
    return df.where((v > 0) & (v < float("inf"))).withColumn("log2_bound", F.log2("mic_value"))


def profile(df: DataFrame, by: list[str], limit: float = 0.5) -> DataFrame:
    """Counts of exact, left- and right-censored values, and whether a median is defined."""
    side = F.col("censoring")
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(F.when(side == "none", 1)).alias("n_exact"),
        F.count(F.when(side == "left", 1)).alias("n_left"), F.count(F.when(side == "right", 1)).alias("n_right"),
    )
    left, right = F.col("n_left") / F.col("n"), F.col("n_right") / F.col("n")
    reason = F.when(left >= limit, "below range").when(right >= limit, "above range")
    return out.withColumns({"left_fraction": left, "right_fraction": right, "identifiable": (left < limit) & (right < limit), "reason": reason})


def median(df: DataFrame, by: list[str], limit: float = 0.5) -> DataFrame:
    """Median log2 value, null with a reason where censoring leaves it open.

    Censored values are taken to both ends of what they allow; the two medians must agree.
    """
    low = F.when(F.col("censoring") == "left", F.lit(float("-inf"))).otherwise(F.col("log2_bound"))
    high = F.when(F.col("censoring") == "right", F.lit(float("inf"))).otherwise(F.col("log2_bound"))
    ends = df.withColumns({"_low": low, "_high": high}).groupBy(*by).agg(F.percentile("_low", 0.5).alias("_low"), F.percentile("_high", 0.5).alias("_high"))
    joined = profile(df, by, limit).join(ends, by)
    agree = (F.col("_low") == F.col("_high")) & (F.abs("_low") < float("inf"))
    return joined.withColumns({
        "median_log2": F.when(F.col("identifiable") & agree, F.col("_low")),
        "reason": F.coalesce("reason", F.when(~F.coalesce(agree, F.lit(False)), "no unique median")),
    }).drop("_low", "_high")


def order_of(a: Column, side_a: Column, b: Column, side_b: Column) -> Column:
    """1, -1 or 0 where a and b can be ordered for certain, else null."""
    exact = (side_a == "none") & (side_b == "none")
    below = (
        (side_a == "left") & (side_b == "right") & (a <= b) | (side_a == "left") & (side_b == "none") & (a < b)
        | (side_a == "none") & (side_b == "right") & (a <= b)
    )
    above = (
        (side_a == "right") & (side_b == "left") & (b <= a) | (side_a == "none") & (side_b == "left") & (b < a)
        | (side_a == "right") & (side_b == "none") & (b <= a)
    )
    return F.when(exact, F.signum(a - b).cast("int")).when(below, -1).when(above, 1)


def pair_sums(bins: DataFrame, keys: list[str], ranges: int = 64) -> DataFrame:
    """Per key: n_pairs, n_decisive and net (above less below) over all pairs of a value of group a and one of group b.

    ``bins`` has log2_bound, censoring, n_a and n_b. No pair is formed: values are put in
    order, and a value of a is above as many of b as running counts say stand below it
    and can be ordered. A left-censored value is only below what is larger and not
    left-censored, a right-censored one only above what is not larger and not
    right-censored. So the work is a sort, however many distinct values there are.
    """
    count = lambda g, s: F.coalesce(F.sum(F.when(F.col("censoring") == s, F.col(f"n_{g}"))), F.lit(0)).alias(f"{g}_{s}")
    values = bins.groupBy(*keys, "log2_bound").agg(*[count(g, s) for g in "ab" for s in ("none", "left", "right")])
    run = running_sums(values, keys, "log2_bound", ["b_none", "b_left", "b_right"], ranges)
    c = F.col
    above = lambda s: c(f"b_{s}_total") - c(f"b_{s}_before") - c(f"b_{s}")
    low = c("b_none_before") + c("b_left_before")
    high = above("none") + above("right") + c("b_right")
    up = c("a_none") * low + c("a_right") * (low + c("b_none") + c("b_left"))
    down = (c("a_none") + c("a_left")) * high
    out = run.groupBy(*keys).agg(F.sum(up).alias("_up"), F.sum(down).alias("_down"), F.sum(c("a_none") * c("b_none")).alias("_even"), *[F.sum(sum((c(f"{g}_{s}") for s in ("left", "right")), c(f"{g}_none"))).alias(f"_{g}") for g in "ab"])
    return out.select(*keys, (c("_a") * c("_b")).alias("n_pairs"), (c("_up") + c("_down") + c("_even")).alias("n_decisive"), (c("_up") - c("_down")).alias("net"))


def with_refusals(sums: DataFrame, min_group: int, min_decisive: float) -> DataFrame:
    """Add refused (why there is no delta) and delta to rows of n_a, n_b, n_pairs, n_decisive and net."""
    reason = F.when((F.col("n_a") < min_group) | (F.col("n_b") < min_group), "too few observations").when(
        (F.col("n_decisive") == 0) | (F.col("n_decisive") < min_decisive * F.col("n_pairs")), "too few decisive pairs"
    )
    return sums.withColumn("refused", reason).withColumn("delta", F.when(reason.isNull(), F.col("net") / F.col("n_decisive"))).drop("net")


def shift(a: DataFrame, b: DataFrame, by: list[str], min_group: int = 5, min_decisive: float = 0.3) -> DataFrame:
    """Cliff's delta of group a over b per key, over the pairs that can be ordered (see ``pair_sums``).

    Refused where a group is small or too few pairs are decisive; a key of one group only is refused too.
    """
    side = lambda df, n_a, n_b: df.select(*by, "log2_bound", "censoring", F.lit(n_a).alias("n_a"), F.lit(n_b).alias("n_b"))
    bins = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(*by, "log2_bound", "censoring").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    sizes = bins.groupBy(*by).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    return with_refusals(null_safe(sizes, pair_sums(bins, by), by), min_group, min_decisive)


def pooled(strata: DataFrame, by: list[str]) -> DataFrame:
    """Delta pooled over strata, weighted by decisive pairs."""
    known = strata.where("delta IS NOT NULL")
    return known.groupBy(*by).agg((F.sum(F.col("delta") * F.col("n_decisive")) / F.sum("n_decisive")).alias("delta"), F.sum("n_decisive").alias("n_decisive"))
