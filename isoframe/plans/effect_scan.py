"""Queries of the effect scan and of resampled statistics, and SQL for those that draw nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.operators import censored, effects, resampling, strata, workflow
from isoframe.plans.bindings import bound, rounded, with_bindings
from isoframe.sources.scratch import stored

MIN_CARRIERS = 20


def _mic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return censored.log2_bounds(censored.parsed(bound(spark, sf_dir, "raw_mic"))).select("isolate_id", "drug", "log2_bound", "censoring")


def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.candidates(bound(spark, sf_dir, "graded"), bound(spark, sf_dir, "carriage"), MIN_CARRIERS)


def _parts(spark: SparkSession, sf_dir: str, *wanted: str) -> list[DataFrame]:
    """Stored tables of the scan: pairs (candidates), strata (their sizes) and bins (their values)."""
    carriage, determinants = stored(bound(spark, sf_dir, "carriage"), "carriage"), stored(bound(spark, sf_dir, "determinants"), "determinants")
    pairs = stored(effects.candidates(bound(spark, sf_dir, "graded"), carriage, MIN_CARRIERS).select("label", "drug"), "pairs")
    placed = stored(strata.background(bound(spark, sf_dir, "isolates"), carriage, determinants), "placed")
    made = {"pairs": pairs, "carriage": carriage, "determinants": determinants}
    if "strata" in wanted:
        made["strata"] = stored(strata.carriers(placed, carriage, pairs, determinants).join(pairs.hint("broadcast"), ["label", "drug"], "left_semi"), "strata")
    if "bins" in wanted:
        made["bins"] = stored(effects.stratum_bins(placed, _mic(spark, sf_dir), carriage, pairs), "bins")
    return [made[w] for w in wanted]


def stratum_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(effects.stratum_shifts(*_parts(spark, sf_dir, "bins")))


def lineage_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(effects.lineage_diversity(*_parts(spark, sf_dir, "strata")))


def _estimates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs, carriage, determinants, groups, bins = _parts(spark, sf_dir, "pairs", "carriage", "determinants", "strata", "bins")
    shared = strata.cooccurrence(carriage, pairs.select("label").distinct(), determinants)
    return effects.estimates(groups, bins, shared), bins


def effect_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_estimates(spark, sf_dir)[0])


def confounded_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(spark, sf_dir)[0].where("state = 'confounded'").select("label", "drug", "n_carriers")


def effect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, bins = _estimates(spark, sf_dir)
    return rounded(workflow.finalised(stored(effects.verdicts(found, effects.resampled(bins, per_task=8, draws=effects.DRAWS)), "verdicts")))


def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linestatus", "l_quantity", (F.col("l_returnflag") == "R").alias("returned"))


def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("price", F.col("l_extendedprice").cast("double"))
    parts = [resampling.quantiles(rows, ["l_linestatus"], "price", q).withColumn("q", F.lit(q)) for q in (0.0, 0.1, 0.5, 0.975)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), 4)


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.bootstrap_interval(_confidence(spark, sf_dir), ["l_linestatus"], "l_quantity"))


def difference_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.difference_interval(_confidence(spark, sf_dir), ["l_linestatus"], "l_quantity", "returned", resampling.mean_of))


def permutation_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.permutation_pvalue(_confidence(spark, sf_dir), ["l_linestatus"], "l_quantity", "returned", resampling.mean_of, 2000))


def risk_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the error rate among answers of confidence 0.5 or more."""
    calls = bound(spark, sf_dir, "calls").where("phenotype IN ('R', 'S') AND call_a <> 'not_assessed' AND confidence >= 0.5")
    wrong = calls.withColumn("wrong", F.when(F.upper(F.substring("call_a", 1, 1)) == F.col("phenotype"), 0.0).otherwise(1.0))
    return rounded(resampling.bootstrap_interval(wrong, ["drug"], "wrong", resampling.mean_of, min_n=10))


_NAMES = "isolates carriage determinants graded raw_mic"
_CANDIDATES = """, nc AS (SELECT label, COUNT(DISTINCT isolate_id) AS n_carriers FROM carriage GROUP BY label HAVING COUNT(DISTINCT isolate_id) >= 20),
cd AS (SELECT DISTINCT g.label AS label, drug, n_carriers FROM graded AS g JOIN nc ON nc.label = g.label WHERE call = 'indeterminate')"""
_STRATA = _CANDIDATES + """,
lg AS (SELECT isolate_id, drug, CASE WHEN trim(mic) LIKE '<%' THEN 'left' WHEN trim(mic) LIKE '>%' THEN 'right' ELSE 'none' END AS s, log2(TRY_CAST(regexp_replace(trim(mic), '^[<>]=?\\s*', '') AS DOUBLE)) AS b FROM raw_mic WHERE trim(mic) <> 'NA'),
bg AS (SELECT c.isolate_id AS isolate_id, d.drug AS drug, string_agg(DISTINCT c.label, '+' ORDER BY c.label) AS b FROM carriage AS c JOIN determinants AS d ON c.label = d.label GROUP BY c.isolate_id, d.drug),
pl AS (SELECT i.isolate_id AS isolate_id, d.drug AS drug, coalesce(b, '') AS background, coalesce(lineage, '?') AS lineage, site_id FROM isolates AS i CROSS JOIN (SELECT DISTINCT drug FROM determinants) AS d LEFT JOIN bg ON bg.isolate_id = i.isolate_id AND bg.drug = d.drug),
st AS (SELECT cd.label AS label, pl.*, c.isolate_id IS NOT NULL AS carrier FROM cd JOIN pl ON pl.drug = cd.drug LEFT JOIN carriage AS c ON c.isolate_id = pl.isolate_id AND c.label = cd.label),
sz AS (SELECT label, drug, background, lineage, site_id, COUNT(CASE WHEN carrier THEN 1 END) AS n_carriers, COUNT(CASE WHEN NOT carrier THEN 1 END) AS n_others FROM st GROUP BY label, drug, background, lineage, site_id HAVING COUNT(CASE WHEN carrier THEN 1 END) > 0),
ob AS (SELECT st.*, s, b FROM st JOIN lg ON lg.isolate_id = st.isolate_id AND lg.drug = st.drug),
pr AS (SELECT a.label AS label, a.drug AS drug, a.background AS background, a.lineage AS lineage, a.site_id AS site_id,
  CASE WHEN a.s = 'none' AND b.s = 'none' THEN sign(a.b - b.b)
    WHEN a.s = 'left' AND b.s = 'right' AND a.b <= b.b OR a.s = 'left' AND b.s = 'none' AND a.b < b.b OR a.s = 'none' AND b.s = 'right' AND a.b <= b.b THEN -1
    WHEN a.s = 'right' AND b.s = 'left' AND b.b <= a.b OR a.s = 'none' AND b.s = 'left' AND b.b < a.b OR a.s = 'right' AND b.s = 'none' AND b.b <= a.b THEN 1 END AS o
  FROM ob AS a JOIN ob AS b ON a.label = b.label AND a.drug = b.drug AND a.background = b.background AND a.lineage = b.lineage AND a.site_id = b.site_id WHERE a.carrier AND NOT b.carrier),
cn AS (SELECT label, drug, background, lineage, site_id, COUNT(CASE WHEN carrier THEN 1 END) AS n_a, COUNT(CASE WHEN NOT carrier THEN 1 END) AS n_b FROM ob GROUP BY label, drug, background, lineage, site_id HAVING COUNT(CASE WHEN carrier THEN 1 END) > 0),
sm AS (SELECT label, drug, background, lineage, site_id, COUNT(*) AS n_pairs, COUNT(o) AS n_decisive, SUM(o) AS net FROM pr GROUP BY label, drug, background, lineage, site_id),
sh AS (SELECT cn.*, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_decisive, 0) AS n_decisive, net, CASE WHEN n_a < 5 OR n_b < 5 THEN 'too few observations' WHEN coalesce(n_decisive, 0) = 0 OR n_decisive < 0.3 * n_pairs THEN 'too few decisive pairs' END AS refused
  FROM cn LEFT JOIN sm ON cn.label = sm.label AND cn.drug = sm.drug AND cn.background = sm.background AND cn.lineage = sm.lineage AND cn.site_id = sm.site_id),
ld AS (SELECT label, drug, CAST(SUM(n) AS DOUBLE) AS everyone, CAST(SUM(CASE WHEN lineage <> '?' THEN n END) AS DOUBLE) AS typed, SUM(CASE WHEN lineage <> '?' THEN n * n END) AS squares
  FROM (SELECT label, drug, lineage, SUM(n_carriers) AS n FROM sz WHERE n_others > 0 GROUP BY label, drug, lineage) GROUP BY label, drug),
tt AS (SELECT label, drug, CAST(SUM(n_carriers) AS BIGINT) AS n_carriers, COUNT(CASE WHEN n_others > 0 THEN 1 END) AS informative FROM sz GROUP BY label, drug),
us AS (SELECT label, drug, COUNT(*) AS n_strata, SUM(CAST(net AS DOUBLE)) / SUM(n_decisive) AS delta, CAST(SUM(n_decisive) AS BIGINT) AS n_decisive FROM sh WHERE refused IS NULL GROUP BY label, drug),
co AS (SELECT c.label AS candidate, d.label AS label, COUNT(*) AS n FROM carriage AS c JOIN carriage AS d ON c.isolate_id = d.isolate_id WHERE c.label IN (SELECT label FROM cd) AND d.label IN (SELECT label FROM determinants) GROUP BY c.label, d.label),
tp AS (SELECT candidate, co.label AS label, CAST(n AS DOUBLE) / n_carriers AS f, row_number() OVER (PARTITION BY candidate ORDER BY n DESC, co.label DESC) AS k FROM co JOIN nc ON nc.label = candidate),
ee AS (SELECT tt.*, n_strata, delta, n_decisive, typed * typed / squares AS diversity, coalesce(typed, 0) / everyone AS share, tp.label AS top_determinant, f,
  CASE WHEN informative = 0 THEN 'confounded' WHEN tt.n_carriers < 10 THEN 'underpowered' WHEN n_strata IS NULL THEN 'not-estimable' ELSE 'estimable' END AS state
  FROM tt LEFT JOIN us ON us.label = tt.label AND us.drug = tt.drug LEFT JOIN ld ON ld.label = tt.label AND ld.drug = tt.drug LEFT JOIN tp ON tp.candidate = tt.label AND k = 1)
"""

QUERIES = {f.__name__: f for f in (
    candidate_selection, stratum_shifts, lineage_diversity, effect_estimates, confounded_effects, effect_verdicts, value_quantiles, bootstrap_intervals, difference_intervals,
    permutation_pvalues, risk_intervals,
)}
#: Resampled results depend on the draws, so they have no SQL; tests compare them with exact laws.
SQL = {
    "candidate_selection": with_bindings(_NAMES, _CANDIDATES + "SELECT * FROM cd"),
    "stratum_shifts": with_bindings(_NAMES, _STRATA + "SELECT label, drug, background, nullif(lineage, '?') AS lineage, site_id, n_a, n_b, n_pairs, n_decisive, refused, CASE WHEN refused IS NULL THEN round(CAST(net AS DOUBLE) / n_decisive, 6) + 0.0 END AS delta FROM sh"),
    "lineage_diversity": with_bindings(_NAMES, _STRATA + "SELECT label, drug, round(typed * typed / squares, 6) + 0.0 AS lineage_diversity, round(coalesce(typed, 0) / everyone, 6) + 0.0 AS typed_fraction FROM ld"),
    "effect_estimates": with_bindings(_NAMES, _STRATA + """SELECT label, drug, n_carriers, state, CASE WHEN state = 'estimable' THEN n_strata ELSE 0 END AS n_strata, CASE WHEN state = 'estimable' THEN round(delta, 6) + 0.0 END AS delta,
  CASE WHEN state = 'estimable' THEN n_decisive END AS n_decisive, CASE WHEN state = 'estimable' THEN round(diversity, 6) + 0.0 END AS lineage_diversity, top_determinant, round(f, 6) + 0.0 AS top_fraction FROM ee"""),
    "confounded_effects": with_bindings(_NAMES, _STRATA + "SELECT label, drug, n_carriers FROM ee WHERE state = 'confounded'"),
    "value_quantiles": """SELECT l_linestatus, COUNT(*) AS n, q, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), q), 4) + 0.0 AS quantile FROM (SELECT l_linestatus, l_extendedprice, CAST(0.0 AS DOUBLE) AS q FROM lineitem) GROUP BY l_linestatus, q
UNION ALL SELECT l_linestatus, COUNT(*), 0.1, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.1), 4) + 0.0 FROM lineitem GROUP BY l_linestatus
UNION ALL SELECT l_linestatus, COUNT(*), 0.5, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 4) + 0.0 FROM lineitem GROUP BY l_linestatus
UNION ALL SELECT l_linestatus, COUNT(*), 0.975, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.975), 4) + 0.0 FROM lineitem GROUP BY l_linestatus""".replace("quantile_cont(CAST(l_extendedprice AS DOUBLE), q)", "MIN(CAST(l_extendedprice AS DOUBLE))"),
}
