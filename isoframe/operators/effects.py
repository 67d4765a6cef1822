"""Effects of variants on measured values within strata of equal background, and their verdicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoframe.operators.censored import pair_sums, with_refusals
from isoframe.operators.joins import dealt, null_safe, sized
from isoframe.operators.resampling import BLOCK, SEED, block_rng, in_blocks

STRATUM = ["background", "lineage", "site_id"]
#: Fixed: refusals, numbers of draws (bootstrap, permutation) and their budgets of pairs.
MIN_CARRIERS, MIN_PER_SIDE, MIN_DECISIVE = 10, 5, 0.3
DRAWS = (1000, 1999)
PAIR_BUDGET, PERMUTATION_BUDGET = 8_000_000, 2_000_000


def candidates(entries: DataFrame, carriage: DataFrame, min_carriers: int, call: str = "indeterminate") -> DataFrame:
    """(label, drug, n_carriers) of catalogue entries (label, drug, call) of the given call with enough carriers."""
    n = carriage.groupBy("label").agg(F.count_distinct("isolate_id").alias("n_carriers"))
    return entries.where(F.col("call") == call).select("label", "drug").distinct().join(n.where(F.col("n_carriers") >= min_carriers), "label")


def stratum_bins(placed: DataFrame, mic: DataFrame, carriage: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per (label, drug, stratum, log2_bound, censoring): carriers n_a and others n_b with that value.

    ``pairs`` are the (label, drug) to look at, none of them a determinant of its drug.
    The values of all isolates of a stratum are counted once; a candidate touches its
    carriers only, and its others are the difference. Carriers meet values by isolate, and
    drugs are looked up after that, so no row of a carrier is shuffled for each drug.
    """
    value = ["log2_bound", "censoring"]
    base = placed.join(mic.hint("merge"), ["isolate_id", "drug"])
    everyone = base.groupBy("drug", *STRATUM, *value).agg(F.count("*").alias("_n"))
    listed = sized(pairs.select("label", "drug").distinct())
    held = base.join(carriage.join(listed, "label", "left_semi").hint("merge"), "isolate_id").join(listed, ["label", "drug"], "left_semi")
    held = held.groupBy("label", "drug", *STRATUM, *value).agg(F.count("*").alias("n_a"))
    touched = held.select("label", "drug", *STRATUM).distinct()
    bins = null_safe(touched, everyone, ["drug", *STRATUM], "inner")
    out = null_safe(bins, held, ["label", "drug", *STRATUM, *value])
    n_a = F.coalesce("n_a", F.lit(0))
    return out.select("label", "drug", *STRATUM, *value, n_a.alias("n_a"), (F.col("_n") - n_a).alias("n_b"))


def stratum_shifts(bins: DataFrame, min_group: int = MIN_PER_SIDE, min_decisive: float = MIN_DECISIVE) -> DataFrame:
    """Per (label, drug, stratum): n_a, n_b, n_pairs, n_decisive, delta and why it is refused (see ``censored.pair_sums``)."""
    keys = ["label", "drug", *STRATUM]
    sizes = bins.groupBy(*keys).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    return with_refusals(null_safe(sizes, pair_sums(bins, keys), keys), min_group, min_decisive)


def lineage_diversity(strata: DataFrame) -> DataFrame:
    """Per (label, drug): effective lineages of carriers in strata that hold others too, null if none is typed, and the typed share.

    ``strata`` has n_carriers and n_others per stratum (see ``strata.carriers``).
    """
    per = strata.where("n_others > 0").groupBy("label", "drug", "lineage").agg(F.sum("n_carriers").alias("_n"))
    typed = F.when(F.col("lineage").isNotNull(), F.col("_n"))
    out = per.groupBy("label", "drug").agg(F.sum(typed).alias("_typed"), F.sum("_n").alias("_all"), F.sum(typed * typed).alias("_squares"))
    t = F.col("_typed").cast("double")
    return out.select("label", "drug", (t * t / F.col("_squares")).alias("lineage_diversity"), (F.coalesce(t, F.lit(0.0)) / F.col("_all")).alias("typed_fraction"))


def estimates(strata: DataFrame, bins: DataFrame, cooccurrence: DataFrame, min_carriers: int = MIN_CARRIERS, min_per_side: int = MIN_PER_SIDE) -> DataFrame:
    """Per (label, drug): carriers, pooled delta and the state that is known before resampling.

    States are confounded (no stratum with a carrier holds others), underpowered (few
    carriers), not-estimable (no stratum gives a comparison) and estimable. The delta is
    pooled over usable strata by their decisive pairs. ``cooccurrence`` has candidate,
    label and fraction; the determinant with the largest fraction is named.
    """
    totals = strata.groupBy("label", "drug").agg(
        F.sum("n_carriers").alias("n_carriers"), F.count(F.when(F.col("n_others") > 0, 1)).alias("_informative"),
        F.count(F.when((F.col("n_carriers") >= min_per_side) & (F.col("n_others") >= min_per_side), 1)).alias("_sized"),
    )
    usable = stratum_shifts(bins, min_per_side).where("refused IS NULL")
    pooled = usable.groupBy("label", "drug").agg(
        F.count("*").alias("n_strata"), (F.sum(F.col("delta") * F.col("n_decisive")) / F.sum("n_decisive")).alias("delta"), F.sum("n_decisive").alias("n_decisive")
    )
    top = cooccurrence.groupBy(F.col("candidate").alias("label")).agg(F.max_by(F.struct("label", "fraction"), F.struct("fraction", "label")).alias("_top"))
    out = totals.join(pooled.hint("merge"), ["label", "drug"], "left").join(lineage_diversity(strata).hint("merge"), ["label", "drug"], "left").join(top.hint("merge"), "label", "left")
    state = F.when(F.col("_informative") == 0, "confounded").when(F.col("n_carriers") < min_carriers, "underpowered").when(F.col("n_strata").isNull(), "not-estimable").otherwise("estimable")
    shown = lambda c: F.when(F.col("state") == "estimable", F.col(c))
    out = out.withColumn("state", state)
    return out.select(
        "label", "drug", "n_carriers", "state", F.coalesce(shown("n_strata"), F.lit(0)).cast("long").alias("n_strata"), shown("delta").alias("delta"), shown("n_decisive").alias("n_decisive"),
        shown("lineage_diversity").alias("lineage_diversity"), F.col("_top.label").alias("top_determinant"), F.col("_top.fraction").alias("top_fraction"),
    )


def _ordered(x: np.ndarray, y: np.ndarray, side: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Net and decisive pairs of many draws at once (one a row), by running counts as in ``censored.pair_sums``.

    Columns are bins; ``place`` numbers their distinct values in order.
    """
    n = int(place.max()) + 1
    spread = lambda c, s: c[:, side == s].astype(float) @ np.eye(n)[place[side == s]]
    (xn, xl, xr), (yn, yl, yr) = ([spread(c, s) for s in ("none", "left", "right")] for c in (x, y))
    upto = lambda c: np.cumsum(c, axis=1)
    low = upto(yn) - yn + upto(yl) - yl
    high = yn.sum(1, keepdims=True) - upto(yn) + yr.sum(1, keepdims=True) - upto(yr) + yr
    up, down = (xn * low + xr * (low + yn + yl)).sum(1), ((xn + xl) * high).sum(1)
    return up - down, up + down + (xn * yn).sum(1)


def resampled(bins: DataFrame, min_per_side: int = MIN_PER_SIDE, seed: int = SEED, per_task: int = 2, draws: tuple[int, int] | None = None) -> DataFrame:
    """Per (label, drug): bootstrap ends low and high of the pooled delta, and its permutation p.

    Both resample within strata: carriers and others each by a multinomial over their
    values, labels by a hypergeometric draw. Sums over pairs add up over strata, so every
    stratum and every few blocks of draws (``per_task``) are a group of their own, and a
    second aggregation puts draw k of all strata together; a draw costs its distinct
    values. Strata with fewer than ``min_per_side`` values on a side are left out;
    without others all is null, as is an interval (a p) of which too few draws are decisive.
    ``draws`` are the numbers of bootstrap and permutation draws of every (label, drug), however
    large; without them they follow its pairs, within budgets, down to a floor.
    """
    keys, pair = ["label", "drug", *STRATUM], ["label", "drug"]
    sizes = bins.groupBy(*keys).agg(F.sum("n_a").alias("_a"), F.sum("n_b").alias("_b")).where((F.col("_a") >= min_per_side) & (F.col("_b") >= min_per_side))
    budget = sizes.groupBy(*pair).agg(F.sum(F.col("_a") * F.col("_b")).alias("_pairs"))
    rounds = lambda least, most, work: F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.lit(work) / F.col("_pairs")))).cast("long")
    boots, perms = [F.lit(n).cast("long") for n in draws] if draws else [rounds(200, DRAWS[0], PAIR_BUDGET), rounds(199, DRAWS[1], PERMUTATION_BUDGET)]
    budget = budget.select(*pair, boots.alias("_boots"), perms.alias("_perms"))
    usable = null_safe(null_safe(bins, sizes.select(*keys), keys, "left_semi"), budget, pair, "inner")
    kinds = dict(bins.dtypes)

    def draw(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        plain = tuple(None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in key[:-1])
        first, last = int(key[-1]), int(table["_to"].iloc[0])
        a, b = table["n_a"].to_numpy(np.int64), table["n_b"].to_numpy(np.int64)
        order = np.lexsort((table["censoring"].to_numpy(str), table["log2_bound"].to_numpy(float)))
        a, b, side = a[order], b[order], table["censoring"].to_numpy(str)[order]
        place = np.unique(table["log2_bound"].to_numpy(float)[order], return_inverse=True)[1]
        out = []
        for block in range(first, last + 1):
            rng = block_rng(seed, plain, block)
            for kind, total in (("boot", int(table["_boots"].iloc[0])), ("perm", int(table["_perms"].iloc[0]))):
                n = min(BLOCK, total - block * BLOCK)
                if n <= 0:
                    continue
                if kind == "boot":
                    x, y = rng.multinomial(a.sum(), a / a.sum(), n), rng.multinomial(b.sum(), b / b.sum(), n)
                else:
                    x = rng.multivariate_hypergeometric(a + b, a.sum(), n, method="marginals")
                    y = (a + b) - x
                net, known = _ordered(x, y, side, place)
                out.append([plain[0], plain[1], kind, block * BLOCK, net, known])
        return pd.DataFrame(out, columns=["label", "drug", "kind", "first", "nets", "knowns"])

    # Dealt to all cores: few bytes of bins make many draws, and would be coalesced to one task.
    blocks = dealt(in_blocks(usable, F.greatest("_boots", "_perms"), per_task), *keys, "_from")
    drawn = blocks.groupBy(*keys, "_from").applyInPandas(draw, f"label {kinds['label']}, drug {kinds['drug']}, kind string, first long, nets array<double>, knowns array<double>")
    drawn = drawn.select(*pair, "kind", "first", F.posexplode(F.arrays_zip(F.col("nets").alias("net"), F.col("knowns").alias("known"))).alias("_at", "_d"))
    drawn = drawn.select(*pair, "kind", (F.col("first") + F.col("_at")).alias("k"), "_d.net", "_d.known")
    sums = drawn.groupBy(*pair, "kind", "k").agg(F.sum("net").alias("net"), F.sum("known").alias("known"))
    seen = pair_sums(usable.select(*bins.columns), keys).groupBy(*pair).agg(F.sum("net").alias("_net"), F.sum("n_decisive").alias("_known"))
    told = null_safe(null_safe(sums, seen, pair), budget, pair)
    delta = F.when(F.col("known") > 0, F.col("net") / F.col("known"))
    boots = F.array_sort(F.collect_list(F.when(F.col("kind") == "boot", delta))).alias("_d")
    perm = (F.col("kind") == "perm") & delta.isNotNull()
    extreme = F.abs(delta) >= F.abs(F.col("_net") / F.col("_known")) - 1e-12
    out = told.groupBy(*pair, "_boots", "_perms", "_known").agg(boots, F.count(F.when(perm, 1)).alias("_valid"), F.count(F.when(perm & extreme, 1)).alias("_extreme"))
    n = F.size("_d")
    enough = n >= F.greatest(F.lit(1), F.floor(F.col("_boots") / 4))
    end = lambda share: F.when(enough, F.get("_d", F.least(n - 1, F.floor(F.lit(share) * n)).cast("int")))
    p = F.when((F.col("_known") > 0) & (F.col("_valid") >= F.floor(F.col("_perms") / 2)), (F.col("_extreme") + 1) / (F.col("_valid") + 1))
    found = out.select(*pair, end(0.025).alias("low"), end(0.975).alias("high"), p.alias("p"))
    return null_safe(bins.select(*pair).distinct(), found, pair)


def verdicts(found: DataFrame, draws: DataFrame, min_carriers: int = MIN_CARRIERS, warn_cooccurrence: float = 0.8, warn_lineages: float = 1.5) -> DataFrame:
    """Verdict per (label, drug) from estimates and draws, with warnings.

    Estimable effects without a p or an interval are underpowered; an interval that
    leaves out zero is evidence-of-effect, any other no-evidence. ``workflow.finalised``
    corrects for the whole family.
    """
    out = found.join(draws.hint("merge"), ["label", "drug"], "left")
    estimable = F.col("state") == "estimable"
    verdict = F.when(~estimable, F.col("state")).when(F.col("p").isNull() | F.col("low").isNull(), "underpowered").when((F.col("low") > 0) | (F.col("high") < 0), "evidence-of-effect").otherwise("no-evidence")
    few: Column = F.col("lineage_diversity") < warn_lineages
    warnings = F.array_compact(F.array(
        F.when(estimable & (F.col("top_fraction") >= warn_cooccurrence), F.concat(F.lit("co-occurs with "), "top_determinant")),
        F.when(estimable & F.col("lineage_diversity").isNull(), "lineage unknown").when(estimable & few & (F.col("n_carriers") >= min_carriers), "few lineages"),
    ))
    return out.select("label", "drug", "n_carriers", "n_strata", "delta", "n_decisive", "lineage_diversity", *[F.when(estimable, F.col(c)).alias(c) for c in ("low", "high", "p")], verdict.alias("verdict"), F.array_join(warnings, "; ").alias("warnings"))

