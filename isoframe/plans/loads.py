"""Queries of scans, locks, checked documents, catalogues with places and further loads, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.operators import accuracy, catalogue, fingerprints, follow_up, reports, views
from isoframe.plans import report_views
from isoframe.plans.bindings import BINDINGS, bound, rounded, with_bindings
from isoframe.sources import documents, tables, variant_text, vcf
from isoframe.sources.scratch import shared_path, stored

CONTEXT_SCHEMA = "report-context.v1"


def scanned_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed files of eight samples, read in splits with the catalogue's positions as filter."""
    rows, catalogue_ = bound(spark, sf_dir, "vcf"), bound(spark, sf_dir, "coordinates")
    line = F.concat_ws("\t", F.lit("chr"), F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), "filter", F.lit("."), F.lit("GT:DP"), F.concat("gt", F.lit(":10")))
    path = shared_path(spark, "variants")
    rows.select((F.col("file").cast("long") % 8).alias("sample"), line.alias("value")).write.partitionBy("sample").option("compression", "gzip").text(path)
    found = vcf.matched(vcf.alleles(variant_text.scan(spark, path, catalogue_)), catalogue_)
    return found.groupBy(F.regexp_extract("file", "sample=([0-9]+)", 1).alias("sample"), "label").agg(F.max("carried").alias("carried"))


def lock_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A locked cohort against a version of it with rows changed, cut out and added, and evidence of which some records errors."""
    cohort = bound(spark, sf_dir, "cohort")
    place, columns, folder = F.col("sample_id"), ["sample_id", "project", "tier", "organism", "bases"], shared_path(spark, "lock")
    evidence = cohort.select(place.cast("string").alias("item"), F.when(place % 211 == 7, "no run").when(place % 2 == 0, " ").alias("errors"))
    fingerprints.write_lock(cohort, ["sample_id"], columns, evidence, folder, "2")
    after = cohort.where(place % 97 != 5).withColumn("organism", F.when(place % 101 != 3, F.col("organism")))
    after = after.unionByName(cohort.where(place % 89 == 1).withColumn("sample_id", place + 1_000_000_000))
    return fingerprints.violations(after, ["sample_id"], columns, folder, "2", stored)


#: A document of each kind by number, and the faults it has: path, reason.
_CONTEXTS = [
    ('{"schema": "report-context.v1", "error_trend": [1, 2.5, 100], "prevalence_rows": [{"total": 5, "resistant": "2"}], "target_rows": [{"gene": "g"}], "validation": {"outcomes": []}, "reference_method": "m"}', []),
    ("no { JSON", [("$", "not JSON")]),
    ("[1]", [("$", "not an object")]),
    ('{"schema": "other", "x": 1}', [("$.schema", "not the schema"), ("$.x", "unknown field")]),
    ('{"schema": "report-context.v1", "error_trend": [1, "a", 101, -0.5, true]}', [("$.error_trend[1]", "not a number"), ("$.error_trend[2]", "not between 0 and 100"), ("$.error_trend[3]", "not between 0 and 100"), ("$.error_trend[4]", "not a number")]),
    (
        '{"schema": "report-context.v1", "prevalence_rows": [{"total": -1}, {"total": 1.5}, {"total": 2, "resistant": 3}, 7, {"n_tested": 4, "n_resistant": 4}, {"resistant": true}]}',
        [("$.prevalence_rows[0]", "tested count"), ("$.prevalence_rows[1]", "tested count"), ("$.prevalence_rows[2]", "resistant above tested"), ("$.prevalence_rows[3]", "not an object"), ("$.prevalence_rows[5]", "resistant count")],
    ),
    ('{"schema": "report-context.v1", "target_rows": [{}, {"target": ""}, {"gene": "g"}, {"gene": null}]}', [("$.target_rows[0]", "no target or gene"), ("$.target_rows[1]", "no target or gene"), ("$.target_rows[3]", "no target or gene")]),
    ('{"schema": "report-context.v1", "validation": [], "reference_method": 5}', [("$.validation", "not an object"), ("$.reference_method", "not text")]),
    ('{"schema": "report-context.v1", "validation": {"other": 1, "outcomes": {}}}', [("$.validation.other", "unknown field"), ("$.validation.outcomes", "not a list")]),
    ('{"baseline_rows": {}, "audit_entries": [1, null]}', [("$.schema", "not the schema"), ("$.baseline_rows", "not a list"), ("$.audit_entries[0]", "not an object"), ("$.audit_entries[1]", "not an object")]),
]


def context_document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of one document for each customer, of a kind that its number chooses."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    value: Column = F.element_at(F.array(*[F.lit(text) for text, _ in _CONTEXTS]), (F.col("c_custkey") % len(_CONTEXTS) + 1).cast("int"))
    return documents.context_errors(rows.select(F.col("c_custkey").cast("string").alias("file"), value.alias("value")), CONTEXT_SCHEMA)


def _observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lists of observations of isolates, some with a fault that the isolate's number chooses."""
    kind, first = F.col("isolate_id") % 9, F.col("observation_id") % 2 == 0
    labs = bound(spark, sf_dir, "labs").select("isolate_id", F.struct(
        F.when((kind == 4) & (F.col("observation_id") < 100), 1).otherwise(F.col("observation_id")).alias("observation_id"), F.when((kind != 5) | first, F.col("drug")).alias("drug"), "result",
        F.when((kind != 3) | first, F.to_json(F.struct("mic"))).otherwise('{"mic":"low"}').alias("mic"), F.when((kind == 1) & first, 1).alias("extra"),
    ).alias("o"), F.col("observation_id").alias("k"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("k", "o"))), lambda x: F.concat(
        F.rtrim(F.to_json(F.struct(x["o"]["observation_id"].alias("observation_id"), x["o"]["drug"].alias("drug"), x["o"]["result"].alias("result"), x["o"]["extra"].alias("extra"))), F.lit("}")),
        F.when(x["o"]["mic"] == "{}", "}").otherwise(F.concat(F.lit(","), F.substring(x["o"]["mic"], 2, 10_000))),
    ))
    files = labs.groupBy(F.col("isolate_id").cast("string").alias("file")).agg(F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")).alias("value"))
    files = files.withColumn("value", F.when(F.col("file").cast("long") % 9 == 2, "nothing").otherwise(F.col("value")))
    return documents.typed_rows(files, {"observation_id": "bigint", "drug": "string", "result": "string", "mic": "double"}, ("observation_id", "drug"), "observation_id")


def typed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir)[0].withColumn("mic", F.floor(F.col("mic") * 1000))


def observation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir)[1]


def catalogue_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalogue.with_coordinates(bound(spark, sf_dir, "master_rows"), bound(spark, sf_dir, "spellings"), "line")
    return out.withColumn("keys", F.array_join("keys", " "))


def drug_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalogue.drug_tiers(bound(spark, sf_dir, "master_rows"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("tier1", "tier2")})


def wide_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = bound(spark, sf_dir, "wide")
    named = wide.select("sample_id", F.col("run").alias("ENA_RUN"), *[F.col(f"{c}_{x}").alias(f"{c.upper()}_{y}") for c in ("rif", "inh") for x, y in (("phenotype", "BINARY_PHENOTYPE"), ("quality", "PHENOTYPE_QUALITY"))])
    return tables.wide_truths(named, {"RIF": "rifampicin", "INH": "isoniazid", "EMB": "ethambutol"}, "sample_id")


def prevalence_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.prevalence(bound(spark, sf_dir, "dated_calls"), ["period", "drug", "lineage", "site"]))


def registry_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = accuracy.with_rates(accuracy.confusion(bound(spark, sf_dir, "calls").where("drug <> '2-HIGH' OR phenotype <> 'R'"), ["drug"]))
    return rounded(reports.registry_readiness(report_views.external_benchmark(spark, sf_dir), rates))


def investigation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("isolate_id")
    evidence = bound(spark, sf_dir, "evidence").select(
        i.alias("sample_id"), "drug", "call", "tier", F.when(i % 10 == 3, "historical").otherwise(F.col("scope")).alias("scope"), F.when(i % 3 > 0, "resistant").alias("comparison"), F.col("call").alias("result"),
        F.when(F.col("engine") == "e2", "unknown").otherwise(F.col("engine")).alias("version"),
    )
    results = evidence.select("sample_id", "drug").distinct()
    i = F.col("sample_id")
    results = results.select(
        "sample_id", "drug", F.when(i % 3 == 0, "indeterminate").otherwise("susceptible").alias("genomic_call"), F.when(i % 4 == 0, "resistant").alias("phenotypic_call"), F.when(i % 2 == 0, "resistant").otherwise("no_call").alias("call"),
        F.when(i % 8 > 0, i % 5 == 0).alias("discordant"), F.when(i % 7 == 0, "insufficient").alias("assay_status"), F.when(i % 6 == 1, "mabscessus").otherwise("mtbc").alias("organism"),
    )
    qc = bound(spark, sf_dir, "qc").withColumnRenamed("isolate_id", "sample_id")
    predictions = results.select("sample_id", "drug", (i % 9 == 2).alias("conflict"))
    return follow_up.investigated(results, evidence, qc, predictions, ("mabscessus", "PROMO"))


QUERIES = {f.__name__: f for f in (
    investigation_findings, scanned_genotypes, lock_violations, context_document_errors, typed_observations, observation_errors, catalogue_coordinates, drug_tiers, wide_truths, prevalence_by_period, registry_readiness,
)}

_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_FAULTS = ", ".join(f"({k}, {_QUOTED(path)}, {_QUOTED(reason)})" for k, (_, faults) in enumerate(_CONTEXTS) for path, reason in faults)
_OBSERVED = """, ob AS (SELECT isolate_id, CAST(isolate_id AS VARCHAR) AS file, isolate_id % 9 AS kind, observation_id % 2 = 0 AS first, CASE WHEN isolate_id % 9 = 4 AND observation_id < 100 THEN 1 ELSE observation_id END AS id, drug, result, mic,
  row_number() OVER (PARTITION BY isolate_id ORDER BY observation_id) - 1 AS pos FROM labs),
oe AS (SELECT DISTINCT file, '$' AS path, 'not JSON' AS reason FROM ob WHERE kind = 2 UNION ALL SELECT file, '$[' || pos || '].extra', 'unknown field' FROM ob WHERE kind = 1 AND first UNION ALL SELECT file, '$[' || pos || '].mic', 'not double' FROM ob WHERE kind = 3 AND NOT first
  UNION ALL SELECT file, '$[' || pos || '].drug', 'missing' FROM ob WHERE kind = 5 AND NOT first UNION ALL SELECT file, '$[*].observation_id=' || id, 'repeated' FROM ob WHERE kind <> 2 GROUP BY file, id HAVING COUNT(*) > 1)
"""


def sql(alleles: str, benchmark: str) -> dict[str, str]:
    """SQL of these queries; ``alleles`` states the alleles of the bound records, ``benchmark`` the external benchmark."""
    told = ", ".join(f"('{name}', '{sure}', {priority}, '{actions}')" for name, (sure, priority, actions) in follow_up.FINDINGS.items())
    return {
        "investigation_findings": with_bindings("evidence qc", f""", ev AS (SELECT isolate_id AS i, drug, call, tier, CASE WHEN isolate_id % 10 = 3 THEN 'historical' ELSE scope END AS scope, CASE WHEN isolate_id % 3 > 0 THEN 'resistant' END AS comparison, nullif(engine, 'e2') AS version FROM evidence),
fa AS (SELECT i, drug, COUNT(*) AS n, COUNT(CASE WHEN tier = 'phenotypic' THEN 1 END) AS m, COUNT(CASE WHEN tier = 'phenotypic' AND comparison <> call THEN 1 END) AS ap, COUNT(DISTINCT version) AS vs, COUNT(CASE WHEN scope = 'historical' THEN 1 END) AS old,
  COUNT(CASE WHEN call = 'indeterminate' AND scope <> 'historical' AND tier <> 'phenotypic' THEN 1 END) AS op, i % 8 > 0 AND i % 5 = 0 AS dc FROM ev GROUP BY i, drug),
fo AS (SELECT i, drug, 'mic_category_mismatch' AS category, n FROM fa WHERE ap > 0 UNION ALL SELECT i, drug, 'phenotype_discordance', n FROM fa WHERE dc AND m > 0 UNION ALL SELECT i, drug, 'engine_discordance', n FROM fa WHERE dc AND m = 0 UNION ALL SELECT i, drug, 'catalogue_drift', n FROM fa WHERE dc AND m = 0 AND vs > 1
  UNION ALL SELECT i, drug, 'coverage_gap', n FROM fa WHERE i % 7 = 0 AND i % 4 <> 0 UNION ALL SELECT i, drug, 'historical_association', n FROM fa WHERE old > 0 UNION ALL SELECT i, drug, 'uncertain_interpretation', op FROM fa WHERE op > 0 UNION ALL SELECT i, drug, 'validation_gap', n FROM fa WHERE i % 3 = 0 AND op = 0 AND NOT dc
  UNION ALL SELECT i, drug, 'ntm_induction_context', n FROM fa WHERE i % 6 = 1 AND drug = 'PROMO' AND i % 2 <> 0 UNION ALL SELECT i, drug, 'mic_prediction_disagreement', 0 FROM fa WHERE i % 9 = 2 UNION ALL SELECT DISTINCT isolate_id, '*', 'analytical_failure', 0 FROM qc WHERE status = 'fail' AND qc_check <> 'callable_mask'),
qf AS (SELECT isolate_id, string_agg(DISTINCT qc_check, '; ' ORDER BY qc_check) AS detail FROM qc WHERE status = 'fail' AND qc_check <> 'callable_mask' GROUP BY isolate_id)
SELECT i AS sample_id, substr(sha256(CAST(i AS VARCHAR) || '|' || drug || '|' || fo.category), 1, 24) AS finding, drug, fo.category AS category, certainty, priority, actions, CASE WHEN fo.category = 'analytical_failure' THEN detail END AS detail, n AS n_evidence
FROM fo JOIN (VALUES {told}) AS t(category, certainty, priority, actions) ON t.category = fo.category LEFT JOIN qf ON qf.isolate_id = i"""),
        "scanned_genotypes": with_bindings("vcf coordinates", alleles + "SELECT CAST(CAST(file AS BIGINT) % 8 AS VARCHAR) AS sample, label, max(carried) AS carried FROM gm GROUP BY 1, 2"),
        "lock_violations": with_bindings("cohort", """ SELECT 'evidence' AS kind, CAST(sample_id AS VARCHAR) AS item, 'no run' AS detail FROM cohort WHERE sample_id % 211 = 7
UNION ALL SELECT 'row', CAST(sample_id AS VARCHAR), 'removed' FROM cohort WHERE sample_id % 97 = 5 UNION ALL SELECT 'row', CAST(sample_id AS VARCHAR), 'changed' FROM cohort WHERE sample_id % 97 <> 5 AND sample_id % 101 = 3
UNION ALL SELECT 'row', CAST(sample_id + 1000000000 AS VARCHAR), 'added' FROM cohort WHERE sample_id % 89 = 1"""),
        "context_document_errors": f"SELECT CAST(c_custkey AS VARCHAR) AS file, path, reason FROM customer JOIN (VALUES {_FAULTS}) AS f(k, path, reason) ON c_custkey % {len(_CONTEXTS)} = k",
        "typed_observations": with_bindings("labs", _OBSERVED + "SELECT file, CAST(pos AS INTEGER) AS pos, id AS observation_id, drug, result, CAST(floor(mic * 1000) AS BIGINT) AS mic FROM ob WHERE file NOT IN (SELECT file FROM oe)"),
        "observation_errors": with_bindings("labs", _OBSERVED + "SELECT file, path, reason FROM oe"),
        "catalogue_coordinates": with_bindings("master_rows spellings", """, gr AS (SELECT *, CASE lower(trim(grade)) WHEN '1) assoc w r' THEN 3 WHEN '3) uncertain significance' THEN 2 WHEN '4) not assoc w r - interim' THEN 1 WHEN '5) not assoc w r' THEN 1 END AS g FROM master_rows WHERE trim(change) <> ''),
en AS (SELECT gene, change, string_agg(DISTINCT drug, ',' ORDER BY drug) AS drugs, CASE max(g) WHEN 3 THEN 'resistant' WHEN 2 THEN 'indeterminate' ELSE 'not_associated' END AS call, gene || '_' || change AS label, arg_min(variant, line) AS variant FROM gr WHERE g IS NOT NULL GROUP BY gene, change),
ks AS (SELECT variant, line, coalesce(nullif(trim(chromosome), ''), 'NC_000962.3') || ':Chromosome:' || position || ':' || ref || '>' || alt AS k FROM spellings WHERE variant <> '' AND position <> 'x' AND ref <> ''),
kl AS (SELECT variant, string_agg(k, ' ' ORDER BY line) AS keys, arg_min(k, line) AS coordinate_key FROM ks GROUP BY variant)
SELECT en.*, coalesce(keys, '') AS keys, coordinate_key FROM en LEFT JOIN kl ON kl.variant = en.variant"""),
        "drug_tiers": with_bindings("master_rows", """ SELECT lower(drug) AS drug, coalesce(string_agg(DISTINCT CASE WHEN trim(tier) = '1' THEN gene END, ',' ORDER BY CASE WHEN trim(tier) = '1' THEN gene END), '') AS tier1,
  coalesce(string_agg(DISTINCT CASE WHEN trim(tier) = '2' THEN gene END, ',' ORDER BY CASE WHEN trim(tier) = '2' THEN gene END), '') AS tier2 FROM master_rows WHERE trim(change) <> '' AND trim(tier) IN ('1', '2') GROUP BY lower(drug)"""),
        "wide_truths": with_bindings("wide", " " + " UNION ALL ".join(
            f"SELECT 'cr_' || run AS isolate_id, '{drug}' AS drug, CASE arg_max(upper(trim({c}_phenotype)), sample_id) WHEN 'R' THEN 'resistant' ELSE 'susceptible' END AS truth FROM wide WHERE upper(trim({c}_phenotype)) IN ('R', 'S') AND upper(trim({c}_quality)) = 'HIGH' GROUP BY run"
            for c, drug in (("rif", "rifampicin"), ("inh", "isoniazid"))
        )),
        "prevalence_by_period": with_bindings("dated_calls", """ SELECT period, drug, lineage, site, COUNT(CASE WHEN phenotype IN ('R', 'S') THEN 1 END) AS n_tested, COUNT(CASE WHEN phenotype = 'R' THEN 1 END) AS n_resistant, CAST(GROUPING(period, drug, lineage, site) AS INTEGER) AS level,
  CASE WHEN COUNT(CASE WHEN phenotype IN ('R', 'S') THEN 1 END) > 0 THEN round(COUNT(CASE WHEN phenotype = 'R' THEN 1 END) / CAST(COUNT(CASE WHEN phenotype IN ('R', 'S') THEN 1 END) AS DOUBLE), 6) + 0.0 END AS rate FROM dated_calls GROUP BY ROLLUP (period, drug, lineage, site)"""),
        "registry_readiness": f"""WITH b AS ({benchmark}), c AS ({BINDINGS['calls']}), k AS (SELECT drug, CAST(COUNT(CASE WHEN call_a = 'resistant' AND phenotype = 'R' THEN 1 END) AS DOUBLE) AS tp, COUNT(CASE WHEN call_a = 'susceptible' AND phenotype = 'R' THEN 1 END) AS fn,
  CAST(COUNT(CASE WHEN call_a = 'susceptible' AND phenotype = 'S' THEN 1 END) AS DOUBLE) AS tn, COUNT(CASE WHEN call_a = 'resistant' AND phenotype = 'S' THEN 1 END) AS fp FROM c WHERE phenotype IN ('R', 'S') AND (drug <> '2-HIGH' OR phenotype <> 'R') GROUP BY drug),
x AS (SELECT b.drug AS drug, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) + 0.0 END AS sensitivity, CASE WHEN tn + fp > 0 THEN round(tn / (tn + fp), 6) + 0.0 END AS specificity, CASE WHEN matched_risk IS NOT NULL THEN matched_coverage ELSE coverage END AS call_rate,
  CASE WHEN matched_risk IS NOT NULL THEN matched_risk ELSE error_rate END AS error_rate, matched_risk, verdict FROM b LEFT JOIN k ON k.drug = b.drug),
y AS (SELECT *, CASE WHEN matched_risk IS NULL THEN 'no risk at the baseline''s coverage: ' || coalesce(verdict, 'no baseline') WHEN sensitivity IS NULL OR specificity IS NULL THEN concat_ws(' and ', CASE WHEN sensitivity IS NULL THEN 'sensitivity' END, CASE WHEN specificity IS NULL THEN 'specificity' END) || ' not estimable' END AS exclusion FROM x)
SELECT drug, sensitivity, specificity, call_rate, error_rate, exclusion, exclusion IS NULL AS ready FROM y""",
    }
