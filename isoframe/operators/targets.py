"""Targets by how easily they are escaped, and mechanisms by how measured values move together."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: words that mark a change as loss of function.
TRUNCATING = r"frameshift|stop|nonsense|truncat|deletion|feature_ablation"


def barriers(escapes: DataFrame, screened: DataFrame, min_escape: int = 5, min_screened: int = 200) -> DataFrame:
    """Per (gene, drug) of ``screened``: routes, escape isolates, their shares, score and band.

    ``escapes`` has gene, drug, variant, consequence, isolate_id and lineage, one row for
    each isolate that carries a route. The score is the mean of four shares between 0 and
    1: few routes, few lineages, no loss of function, rare escape. Small screens are not
    estimated, and hardly any escape is a state of its own, not a high score.
    """
    routes = escapes.groupBy("gene", "drug", "variant").agg(F.count_distinct("isolate_id").alias("_n"), F.max(F.lower("consequence").rlike(TRUNCATING)).alias("_cut"))
    sums = routes.groupBy("gene", "drug").agg(F.count("*").alias("n_routes"), F.sum("_n").alias("n_escape_isolates"), F.sum(F.when(F.col("_cut"), F.col("_n")).otherwise(0)).alias("_lost"))
    spread = escapes.where("lineage IS NOT NULL").select("gene", "drug", "variant", "lineage").distinct().groupBy("gene", "drug", "lineage").agg(F.count("*").alias("_v"))
    spread = spread.groupBy("gene", "drug").agg(F.sum("_v").alias("_all"), F.sum(F.col("_v") * F.col("_v")).alias("_squares"))
    out = screened.join(sums.hint("merge"), ["gene", "drug"], "left").join(spread.hint("merge"), ["gene", "drug"], "left").na.fill(0, ["n_routes", "n_escape_isolates", "_lost"])
    n, total = F.col("n_escape_isolates"), F.col("_all").cast("double")
    breadth = F.coalesce(total * total / F.col("_squares"), F.lit(0.0))
    frequency, lost = F.when(F.col("n_screened") > 0, n / F.col("n_screened")), F.when(n > 0, F.col("_lost") / n)
    shares = [
        1 - F.least(F.lit(1.0), F.col("n_routes") / 20), 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (breadth - 1) / 3)), 1 - F.coalesce(lost, F.lit(0.0)),
        1 - F.least(F.lit(1.0), F.coalesce(frequency, F.lit(0.0)) / 0.1),
    ]
    score = F.when((F.col("n_screened") >= min_screened) & (n >= min_escape), sum(shares[1:], shares[0]) / 4)
    band = F.when(F.col("n_screened") < min_screened, "not-estimated").when(n < min_escape, "no-observed-escape").when(score >= 0.66, "high").when(score >= 0.40, "moderate").otherwise("low")
    return out.select("gene", "drug", "n_screened", "n_routes", "n_escape_isolates", frequency.alias("frequency"), lost.alias("truncating_fraction"), breadth.alias("lineage_breadth"), score.alias("score"), band.alias("band"))


def ranked(scored: DataFrame) -> DataFrame:
    """Highest barrier first; those without a score come last."""
    return scored.orderBy(F.col("score").desc_nulls_last(), "gene", "drug")


def contrast(scored: DataFrame, low: str, high: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Per drug: whether the gene known as a low barrier scores below the one known as a high barrier."""
    name = F.col("gene")
    for alias, gene in (aliases or {}).items():
        name = F.when(F.col("gene") == alias, gene).otherwise(name)
    of = lambda g, c: F.max(F.when(name == (aliases or {}).get(g, g), F.col(c)))
    out = scored.groupBy("drug").agg(of(low, "band").alias("low_band"), of(high, "band").alias("high_band"), of(low, "score").alias("low_score"), of(high, "score").alias("high_score"))
    verdict = (
        F.when(F.col("low_band").isNull() | F.col("high_band").isNull(), "not-run").when(F.col("low_score").isNull() | F.col("high_score").isNull(), "underpowered")
        .when(F.col("low_score") < F.col("high_score"), "reproduces-known-contrast").otherwise("fails-known-contrast")
    )
    return out.withColumn("verdict", verdict)


def two_modes(mic: DataFrame, by: list[str], min_exact: int = 40, max_censored: float = 0.25, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """Two normal components of the exact log2 values per key, or why they are refused.

    Values are counted per distinct (value, censoring) first, so a key costs its distinct
    values in one task.
    """
    counts = mic.groupBy(*by, "log2_bound", "censoring").agg(F.count("*").alias("_n"))

    def fit(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        exact = t[t["censoring"] == "none"].groupby("log2_bound")["_n"].sum()
        x, w = exact.index.to_numpy(float), exact.to_numpy(float)
        n, total = w.sum(), t["_n"].sum()
        share = lambda side: t.loc[t["censoring"] == side, "_n"].sum() / total
        refused, result = None, [None] * 6
        if n < min_exact:
            refused = "few exact values"
        elif max(share("left"), share("right")) > max_censored:
            refused = "censored"
        elif len(x) == 1:
            refused = "one value"
        else:
            upto = np.cumsum(w) - 1
            at = lambda p: x[np.searchsorted(upto, math.floor(p))] + (p - math.floor(p)) * (x[np.searchsorted(upto, math.ceil(p))] - x[np.searchsorted(upto, math.floor(p))])
            mean = (x * w).sum() / n
            mu = np.array([at(0.25 * (n - 1)), at(0.75 * (n - 1))])
            sd = np.full(2, max(math.sqrt(((x - mean) ** 2 * w).sum() / n), 0.25))
            share_of, before = np.full(2, 0.5), None
            for _ in range(rounds):
                s = np.maximum(sd, 1e-3)
                density = share_of * np.exp(-0.5 * ((x[:, None] - mu) / s) ** 2) / (s * math.sqrt(2 * math.pi))
                all_ = density.sum(1)
                part = np.where(all_[:, None] > 0, density / np.where(all_ > 0, all_, 1)[:, None], 0.5)
                mass = (part * w[:, None]).sum(0)
                if mass.min() < 1:
                    refused = "one component collapsed"
                    break
                mu = (part * (w * x)[:, None]).sum(0) / mass
                sd = np.sqrt(np.maximum(1e-6, (part * w[:, None] * (x[:, None] - mu) ** 2).sum(0) / mass))
                share_of = mass / n
                likelihood = (w[all_ > 0] * np.log(all_[all_ > 0])).sum()
                if before is not None and abs(likelihood - before) < tolerance:
                    break
                before = likelihood
            if refused is None:
                order = np.argsort(mu, kind="stable")
                result = [float(v) for pair in (mu[order], sd[order], share_of[order]) for v in pair]
        return pd.DataFrame([[*key, int(n), *result, refused]], columns=[*by, "n_exact", "mean_low", "mean_high", "sd_low", "sd_high", "weight_low", "weight_high", "refused"])

    kinds = dict(mic.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + ["n_exact long"] + [f"{c} double" for c in ("mean_low", "mean_high", "sd_low", "sd_high", "weight_low", "weight_high")] + ["refused string"])
    return counts.groupBy(*by).applyInPandas(fit, schema)


def mechanisms(shifts: DataFrame, drugs: list[str], min_delta: float = 0.15) -> DataFrame:
    """Per label: efflux-like if all of two or more drugs move one way by ``min_delta``, target-like if one alone does, else indeterminate.

    ``shifts`` has label, drug and delta (null where refused).
    """
    own = shifts.where(F.col("drug").isin(drugs) & F.col("delta").isNotNull())
    all_ = shifts.select("label").distinct()
    d = F.col("delta")
    out = own.groupBy("label").agg(
        F.count("*").alias("n_estimable"), F.min(F.abs(d)).alias("least"), (F.bool_and(d > 0) | F.bool_and(d < 0)).alias("concordant"),
        F.count(F.when(F.abs(d) >= min_delta, 1)).alias("n_moved"), F.array_join(F.sort_array(F.collect_list(F.when(F.abs(d) >= min_delta, F.col("drug")))), ",").alias("moved"),
    )
    joined = all_.join(out.hint("merge"), "label", "left").na.fill(0, ["n_estimable", "n_moved"]).na.fill("", ["moved"])
    kind = F.when(F.col("n_estimable") < 2, "indeterminate").when(F.col("concordant") & (F.col("least") >= min_delta), "efflux-like").when(F.col("n_moved") == 1, "target-like").otherwise("indeterminate")
    return joined.select("label", "n_estimable", "n_moved", "moved", kind.alias("mechanism"))


def reference_group(isolates: DataFrame, carriage: DataFrame, tested: DataFrame) -> DataFrame:
    """Isolates that carry none of the tested labels."""
    held = carriage.join(tested.select("label").distinct().hint("merge"), "label", "left_semi").select("isolate_id").distinct()
    return isolates.join(held.hint("merge"), "isolate_id", "left_anti")


def discrimination(found: DataFrame, efflux_genes: list[str], target_gene: str, n_reference: int, min_agreement: float = 0.6, min_reference: int = 5) -> DataFrame:
    """One row: whether known regulators look efflux-like and the known target target-like often enough."""
    gene = F.substring_index("label", "_", 1)
    share = lambda mine, kind: F.try_divide(F.count(F.when(mine & (F.col("mechanism") == kind), 1)).cast("double"), F.count(F.when(mine, 1)))
    out = found.agg(share(gene.isin(efflux_genes), "efflux-like").alias("efflux_right"), share(gene == target_gene, "target-like").alias("target_right"), F.lit(n_reference).cast("long").alias("n_reference"))
    verdict = F.when((F.col("n_reference") < min_reference) | F.col("efflux_right").isNull() | F.col("target_right").isNull(), "not-run").when(
        (F.col("efflux_right") >= min_agreement) & (F.col("target_right") >= min_agreement), "discriminates"
    ).otherwise("does-not-discriminate")
    return out.withColumn("verdict", verdict)
