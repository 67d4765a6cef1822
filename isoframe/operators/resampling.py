"""Quantiles, resampled intervals and permutation tests per group.

Resampling works on counts of distinct values, so a group costs its distinct values and
not its rows. Draws are made in blocks whose seeds depend on the key and the block's
number alone; the blocks of a key are dealt to tasks and their draws put together again,
so a heavy key is shared out and the result is the same however blocks are dealt.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.operators.joins import null_safe

SEED = 20240229
#: A statistic of values (ascending) for many draws at once: counts has one row for each draw.
Statistic = Callable[[np.ndarray, np.ndarray], np.ndarray]


def quantiles(df: DataFrame, by: list[str], value: str, q: float, accuracy: int = 100_000) -> DataFrame:
    """Exact type-7 quantile (linear between ranks) per key, with n, the number of values.

    An approximate pass finds a narrow band of values round the rank, rows below it are
    counted, and only the distinct values of the band are ranked.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    around = [max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)]
    band = known.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", around, accuracy).alias("_band"))
    near = null_safe(known, band, by, "inner", "broadcast" if band.count() <= 1_000_000 else "merge")
    # One distinct value above the band keeps the upper neighbour of its last rank.
    inside = near.where("_v >= _band[0]").withColumn("_above", F.col("_v") > F.col("_band")[1])
    below = near.where("_v < _band[0]").groupBy(*by).agg(F.count("*").alias("_below"), F.max("_v").alias("_prev"))
    kept = inside.where("NOT _above").groupBy(*by, "_v", "n").agg(F.count("*").alias("_n"))
    next_up = inside.where("_above").groupBy(*by, "n").agg(F.min("_v").alias("_v")).select(*by, "_v", "n", F.lit(1).cast("long").alias("_n"))
    values = kept.unionByName(next_up)
    values = null_safe(values, below, by).withColumn("_below", F.coalesce("_below", F.lit(0)))
    order = Window.partitionBy(*by).orderBy("_v")
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_below")
    ranked = values.withColumn("_last", upto - 1).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    place = F.lit(q) * (F.col("n") - 1)
    at = lambda p: F.coalesce(F.max(F.when((F.col("_first") <= p) & (p <= F.col("_last")), F.col("_v"))), F.max("_prev"))
    out = ranked.groupBy(*by, "n").agg(at(F.floor(place)).alias("_lo"), at(F.ceil(place)).alias("_hi"))
    return out.select(*by, "n", (F.col("_lo") + (place - F.floor(place)) * (F.col("_hi") - F.col("_lo"))).alias("quantile"))


def median_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Median of each draw."""
    upto = counts.cumsum(1)
    n = upto[:, -1:]
    at = lambda k: values[(upto <= k).sum(1).clip(max=len(values) - 1)]
    return (at((n - 1) // 2) + at(n // 2)) / 2


def mean_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of each draw."""
    return counts @ values / counts.sum(1)


BLOCK = 250


def block_rng(seed: int, key: tuple, block: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(key).encode()), block])


def in_blocks(rows: DataFrame, iterations: int | Column, per_task: int) -> DataFrame:
    """The rows once for each group of ``per_task`` blocks, with the group's first and last block as _from and _to."""
    last = F.ceil((F.lit(iterations) if isinstance(iterations, int) else iterations) / BLOCK) - 1
    firsts = F.sequence(F.lit(0).cast("long"), last, F.lit(per_task).cast("long"))
    return rows.withColumn("_from", F.explode(firsts)).withColumn("_to", F.least(F.col("_from") + per_task - 1, last))


def _interval(draws: DataFrame, by: list[str], facts: list[str], level: float) -> DataFrame:
    """The percentile ends of each key's draws (column draws, an array for each group of blocks); null without draws."""
    tail = (1 - level) / 2
    out = draws.groupBy(*by, *facts).agg(F.array_sort(F.flatten(F.collect_list("draws"))).alias("_d"))
    n = F.size("_d")
    at = lambda share: F.get("_d", F.least(n - 1, F.floor(F.lit(share) * n)).cast("int"))
    return out.select(*by, *facts, at(tail).alias("low"), at(1 - tail).alias("high"))


def _counted(df: DataFrame, by: list[str], value: str, side: str | None = None) -> DataFrame:
    keys = [*by, F.col(value).cast("double").alias("_v"), *([F.col(side).alias("_side")] if side else [])]
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))


def _per_block(bins: DataFrame, by: list[str], iterations: int, per_task: int, result: str, run: Callable[[tuple, int, int, pd.DataFrame], list]) -> DataFrame:
    """One row of ``by`` and ``result`` for each key and group of blocks: what ``run`` makes of the key's bins, each block in turn."""
    kinds = dict(bins.dtypes)
    names = [x.split()[0] for x in result.split(", ")]

    def one(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        plain = tuple(k.item() if hasattr(k, "item") else k for k in key[:-1])
        return pd.DataFrame([[*plain, *run(plain, int(key[-1]), int(table["_to"].iloc[0]), table.sort_values("_v"))]], columns=[*by, *names])

    return in_blocks(bins, iterations, per_task).groupBy(*by, "_from").applyInPandas(one, ", ".join([f"{c} {kinds[c]}" for c in by] + [result]))


def _sizes(iterations: int, first: int, last: int) -> list[tuple[int, int]]:
    """The blocks first..last and how many draws each makes."""
    return [(k, min(BLOCK, iterations - k * BLOCK)) for k in range(first, last + 1)]


def bootstrap_interval(df: DataFrame, by: list[str], value: str, statistic: Statistic = median_of, iterations: int = 2000, level: float = 0.95, min_n: int = 8, seed: int = SEED, per_task: int = 2) -> DataFrame:
    """n, low and high of a percentile bootstrap per key; null below ``min_n`` values."""

    def run(key: tuple, first: int, last: int, bins: pd.DataFrame) -> list:
        values, counts = bins["_v"].to_numpy(), bins["_n"].to_numpy()
        n = int(counts.sum())
        if n < min_n:
            return [n, []]
        return [n, np.concatenate([statistic(values, block_rng(seed, key, k).multinomial(n, counts / n, m)) for k, m in _sizes(iterations, first, last)])]

    return _interval(_per_block(_counted(df, by, value), by, iterations, per_task, "n long, draws array<double>", run), by, ["n"], level)


def _sides(bins: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = bins.pivot_table(index="_v", columns="_side", values="_n", aggfunc="sum", fill_value=0)
    side = lambda s: wide[s].to_numpy(dtype=np.int64) if s in wide else np.zeros(len(wide), np.int64)
    return wide.index.to_numpy(dtype=float), side(True), side(False)


def difference_interval(
    df: DataFrame, by: list[str], value: str, in_a: str, statistic: Statistic = median_of, iterations: int = 2000, level: float = 0.95, min_n: int = 5, seed: int = SEED, per_task: int = 2
) -> DataFrame:
    """n_a, n_b, low and high of the statistic of rows where ``in_a`` less that of the others; null where a side is small."""

    def run(key: tuple, first: int, last: int, bins: pd.DataFrame) -> list:
        values, a, b = _sides(bins)
        n_a, n_b = int(a.sum()), int(b.sum())
        if min(n_a, n_b) < min_n:
            return [n_a, n_b, []]
        draws = []
        for k, m in _sizes(iterations, first, last):
            rng = block_rng(seed, key, k)
            one, two = (statistic(values, rng.multinomial(n, x / n, m)) for x, n in ((a, n_a), (b, n_b)))
            draws.append(one - two)
        return [n_a, n_b, np.concatenate(draws)]

    return _interval(_per_block(_counted(df, by, value, in_a), by, iterations, per_task, "n_a long, n_b long, draws array<double>", run), by, ["n_a", "n_b"], level)


def permutation_pvalue(
    df: DataFrame, by: list[str], value: str, in_a: str, statistic: Statistic = median_of, iterations: int = 10_000, min_n: int = 5, seed: int = SEED, per_task: int = 10
) -> DataFrame:
    """n_a, n_b and the two-sided p of the difference under shuffled labels (add-one); null where a side is small."""

    def run(key: tuple, first: int, last: int, bins: pd.DataFrame) -> list:
        values, a, b = _sides(bins)
        n_a, n_b = int(a.sum()), int(b.sum())
        if min(n_a, n_b) < min_n:
            return [n_a, n_b, None]
        gap = lambda x, y: np.abs(statistic(values, x) - statistic(values, y))
        seen, n = gap(a[None], b[None]) - 1e-12, 0
        for k, m in _sizes(iterations, first, last):
            drawn = block_rng(seed, key, k).multivariate_hypergeometric(a + b, n_a, m, method="marginals")
            n += int((gap(drawn, (a + b) - drawn) >= seen).sum())
        return [n_a, n_b, n]

    found = _per_block(_counted(df, by, value, in_a), by, iterations, per_task, "n_a long, n_b long, _n long", run)
    return found.groupBy(*by, "n_a", "n_b").agg(((F.sum("_n") + 1) / (iterations + 1)).alias("p"))
