"""Queries of follow-up operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.operators import federated, follow_up
from isoframe.plans.bindings import bound, rounded, with_bindings


def priority_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = bound(spark, sf_dir, "calls").where("phenotype IN ('R', 'S')").select("drug", F.col("confidence").alias("p"), (F.col("phenotype") == "R").alias("truth"))
    calibrated = federated.calibration_error(calls, ["drug"], min_n=1500)
    predicted = bound(spark, sf_dir, "labs").select(F.col("observation_id").alias("variant"), "drug", (F.col("observation_id") % 100 / 100).alias("p"))
    return rounded(follow_up.priority_signals(predicted, calibrated.select("drug", "ece", "refused")).select("variant", "drug", "p"))


def mic_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "labs").select("isolate_id", "drug", "observation_id", F.coalesce(F.col("mic").cast("string"), F.lit("NA")).isNotNull().alias("evaluable"), F.when(F.col("quality") == "pass", "high").otherwise("low").alias("quality"), F.concat(F.lit("m"), F.col("observation_id").cast("string")).alias("mic"))
    return follow_up.mic_panel(rows, ["1-URGENT", "2-HIGH"], "observation_id")


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("variant"), F.col("p_type").alias("drug"))


def attached_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_suppkey > 3").select(F.col("l_partkey").alias("variant"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("source"), F.when(F.col("l_returnflag") == "R", "harmful").otherwise("neutral").alias("effect"))
    return follow_up.attached_claims(_queue(spark, sf_dir), claims)


def matched_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("variant")).agg(F.min("l_suppkey").alias("s"), F.count("*").alias("n"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("variant"), F.col("p_type").alias("drug"))
    rows = p.join(part, "variant").select("variant", "drug", F.concat(F.lit("m"), (F.col("s") % 4).cast("string")).alias("model"), F.when(F.col("n") > 3, "L1").alias("lineage"))
    twice = rows.unionByName(rows.where("lineage IS NULL AND model = 'm1'"))
    models = part.select("drug").distinct().where("drug < 'P'").select("drug", F.explode(F.array(F.lit("m0"), F.lit("m1"))).alias("model"))
    scopes = models.select("drug", "model", F.explode(F.array(F.lit("unknown"), F.lit("L1"))).alias("lineage"))
    return follow_up.matched_predictions(twice, _queue(spark, sf_dir).where("variant % 2 = 0"), scopes).groupBy("violation").agg(F.count("*").alias("n"))


def conflict_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    conflicts = bound(spark, sf_dir, "results").where("genomic_call <> phenotypic_call").groupBy("drug").agg(F.count("*").alias("n_conflicts"))
    lines = bound(spark, sf_dir, "performance").withColumn("p", F.substring("model", 2, 9).cast("int")).select(F.explode(F.array(F.lit("1-URGENT"), F.when(F.col("p") < 3, "2-HIGH"))).alias("drug"), F.col("p").alias("place"), "model").distinct()
    return follow_up.conflict_context(conflicts, lines.where("drug IS NOT NULL").select("drug", "place", F.col("model").alias("line")))


def context_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row"), (F.col("p_size") - 3).alias("total"), (F.col("p_partkey") % 60).alias("resistant"))
    return follow_up.context_errors(rows)


def follow_up_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = bound(spark, sf_dir, "findings").select(F.col("sample").alias("sample_id"), F.concat_ws("_", "gene", F.col("k").cast("string"), "change").alias("finding"), "drug", F.col("k").alias("priority"), F.concat(F.lit("a"), (F.col("k") % 4).cast("string")).alias("action"))
    menu = spark.createDataFrame([("o1", "a0", True, 5.0), ("o2", "a0", True, 3.0), ("o3", "a1", True, None), ("o4", "a2", False, 1.0), ("o5", "a1", False, 2.0)], "option string, action string, available boolean, cost double")
    return follow_up.plans(findings.distinct(), menu, 8.0)


QUERIES = {f.__name__: f for f in (priority_signals, mic_panel, attached_claims, matched_predictions, conflict_context, context_errors, follow_up_plans)}
#: A plan spends a budget step by step, so it has no SQL; a test compares it with cases worked by hand.
SQL = {
    "priority_signals": with_bindings("calls labs", """, ok AS (SELECT drug FROM calls WHERE phenotype IN ('R', 'S') GROUP BY drug HAVING COUNT(*) >= 1500 AND COUNT(CASE WHEN phenotype = 'R' THEN 1 END) >= 10 AND COUNT(CASE WHEN phenotype = 'S' THEN 1 END) >= 10)
SELECT observation_id AS variant, drug, round(observation_id % 100 / CAST(100 AS DOUBLE), 6) + 0.0 AS p FROM labs WHERE observation_id % 100 >= 50 AND drug IN (SELECT drug FROM ok)"""),
    "mic_panel": with_bindings("labs", " SELECT isolate_id, drug, 'm' || CAST(MAX(observation_id) AS VARCHAR) AS mic FROM labs WHERE quality = 'pass' AND drug IN ('1-URGENT', '2-HIGH') GROUP BY isolate_id, drug"),
    "attached_claims": """WITH cl AS (SELECT l_partkey AS variant, 's' || CAST(l_suppkey % 5 AS VARCHAR) AS source, CASE WHEN l_returnflag = 'R' THEN 'harmful' ELSE 'neutral' END AS effect FROM lineitem WHERE l_suppkey > 3),
sa AS (SELECT variant, COUNT(*) AS n, string_agg(DISTINCT source || ': ' || effect, '; ' ORDER BY source || ': ' || effect) AS c, COUNT(DISTINCT effect) > 1 AS k FROM cl GROUP BY variant)
SELECT p_partkey AS variant, p_type AS drug, coalesce(n, 0) AS n_claims, coalesce(c, '') AS claims, coalesce(k, false) AS contradictory FROM part LEFT JOIN sa ON variant = p_partkey""",
    "matched_predictions": """WITH pr AS (SELECT l_orderkey AS variant, p_type AS drug, 'm' || CAST(MIN(l_suppkey) % 4 AS VARCHAR) AS model, CASE WHEN COUNT(*) > 3 THEN 'L1' END AS lineage FROM lineitem JOIN part ON p_partkey = l_orderkey GROUP BY l_orderkey, p_type),
tw AS (SELECT *, CASE WHEN lineage IS NULL AND model = 'm1' THEN 2 ELSE 1 END AS n FROM pr)
SELECT CASE WHEN n > 1 THEN 'repeated' WHEN NOT (drug < 'P' AND model IN ('m0', 'm1')) THEN 'not approved' WHEN variant % 2 > 0 THEN 'not queued' END AS violation, CAST(SUM(n) AS BIGINT) AS n FROM tw GROUP BY 1""",
    "conflict_context": with_bindings("results performance", """, cf AS (SELECT drug, COUNT(*) AS n_conflicts FROM results WHERE genomic_call <> phenotypic_call GROUP BY drug), li AS (SELECT DISTINCT model, CAST(substr(model, 2) AS INTEGER) AS p FROM performance),
ls AS (SELECT '1-URGENT' AS drug, model, p FROM li UNION ALL SELECT '2-HIGH', model, p FROM li WHERE p < 3), lk AS (SELECT *, row_number() OVER (PARTITION BY drug ORDER BY p, model) AS k, COUNT(*) OVER (PARTITION BY drug) AS n FROM ls),
lt AS (SELECT drug, string_agg(CASE WHEN k <= 6 THEN model END, '; ' ORDER BY k) || CASE WHEN MAX(n) > 6 THEN '; and ' || CAST(MAX(n) - 6 AS VARCHAR) || ' more' ELSE '' END AS c FROM lk GROUP BY drug)
SELECT cf.drug AS drug, n_conflicts, coalesce(c, '') AS context FROM cf LEFT JOIN lt ON lt.drug = cf.drug"""),
    "context_errors": "SELECT p_partkey AS row, CASE WHEN p_size < 3 THEN 'negative' ELSE 'resistant above tested' END AS reason FROM part WHERE p_size < 3 OR p_partkey % 60 > p_size - 3",
}
