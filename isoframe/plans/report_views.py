"""Queries of checks, linked evidence and report views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions.measures import concentration_call
from isoframe.operators import checks, federated, linked, reports
from isoframe.plans.bindings import BINDINGS, bound, rounded, with_bindings
from isoframe.sources import phenotypes

CONTROLS = ["species_confirmation", "contamination", "duplication", "insert_size"]
ORDER = {"nonsense": 0, "frameshift": 1, "deletion": 2, "missense": 3, "inframe_indel": 4, "upstream": 5, "rrna": 6, "unknown": 7, "synonymous": 8}


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "runs")
    rules = {"platform": F.upper("platform") == "ILLUMINA", "layout": F.col("layout") == "PAIRED", "bases": F.col("bases") > 50000}
    return checks.violations(rows, "run", rules, ("biosample",)).groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def unfounded_resistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "evidence").withColumn("tier", F.when(F.col("scope") == "variant", "inferred").otherwise(F.col("tier")))
    return checks.unfounded_resistance(rows).groupBy("isolate_id").agg(F.count("*").alias("n"))


def screened_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.screened_runs(bound(spark, sf_dir, "runs"), ["low"]).select("run", "reject_reason")


def discovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.discovery_summary(checks.screened_runs(bound(spark, sf_dir, "runs"), ["low"]))


def cohort_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.benchmark_part(bound(spark, sf_dir, "runs"), "outcome").groupBy("part").agg(F.count("*").alias("n"))


def verified_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "runs")
    other = rows.where("run % 8 > 0").withColumn("platform", F.when(F.col("run") % 5 == 0, "other").otherwise(F.upper("platform"))).withColumn("bases", F.col("bases") + F.when(F.col("run") % 9 == 0, 1).otherwise(0))
    return checks.compared_fields(rows, other, "run", ["platform", "layout", "bases"])


def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    attached = bound(spark, sf_dir, "runs").select(F.col("run").alias("report"), F.col("custkey").alias("isolate_id"), F.when(F.col("run") % 3 > 0, "BUILDING").alias("organism"))
    return checks.identity_conflicts(attached, bound(spark, sf_dir, "contexts"), "isolate_id", ["organism"])


def lab_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    labs = bound(spark, sf_dir, "labs")
    labs = labs.withColumn("mic_call", concentration_call(F.col("mic"), F.lit("none"), F.lit(3.0), F.lit(True)))
    return checks.lab_evidence(labs).select("observation_id", "isolate_id", "drug", "call", "tier", "notes")


def qc_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.qc_table(bound(spark, sf_dir, "isolates"), bound(spark, sf_dir, "qc"), CONTROLS)


def qc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.status_counts(qc_tables(spark, sf_dir))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 25").select(F.col("p_brand").alias("locus")).distinct().where("locus < 'Brand#3'")


def panel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.restricted(bound(spark, sf_dir, "coverage"), _panel(spark, sf_dir)).groupBy("locus", "kept").agg(F.count("*").alias("n"))


def panel_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unsupported(bound(spark, sf_dir, "profile"), _panel(spark, sf_dir))


def evidence_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks.evidence_ids(bound(spark, sf_dir, "labs"), ["isolate_id", "drug", "result", "quality"])
    return rows.groupBy("evidence_id").agg(F.count("*").alias("n"))


def calibration_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "labs").select("observation_id", F.when(F.col("observation_id") % 2 == 0, "illumina").otherwise("nanopore").alias("platform"), "drug", F.when(F.col("observation_id") % 3 > 0, F.concat(F.lit("L"), (F.col("observation_id") % 4).cast("string"))).alias("lineage"))
    table = bound(spark, sf_dir, "calibrations")
    return rounded(linked.calibrated(rows, table, ["lod50"]))


def variant_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = federated.associations(bound(spark, sf_dir, "observations"))
    rows = bound(spark, sf_dir, "observations").where("variant IS NOT NULL").select("variant", "drug").distinct()
    return rounded(linked.priors(rows, found))


def described_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bound(spark, sf_dir, "metadata").where("cluster_id > 20").select("isolate_id", F.when(F.col("patient_id") % 3 > 0, F.concat(F.lit("M"), (F.col("patient_id") % 3).cast("string"))).alias("lineage"), F.col("site_id"), "partition")
    return linked.with_metadata(bound(spark, sf_dir, "isolates"), m)


def _noted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    results = bound(spark, sf_dir, "variants").select("sample_id", F.lit("STANDARD").alias("drug"), F.when(F.col("sample_id") % 2 == 0, "resistant").alias("call"), F.lit("catalogued").alias("tier"))
    return bound(spark, sf_dir, "pair_rules"), bound(spark, sf_dir, "variants"), results


def co_observed_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return linked.co_observed_classes(*_noted(spark, sf_dir))


def co_observed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked.co_observed(*_noted(spark, sf_dir))


def expression_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = bound(spark, sf_dir, "variants").where("region = 'promoter'").select("sample_id", "gene", "variant_key", F.concat(F.lit("d"), (F.col("pos") % 3).cast("string")).alias("drug"))
    obs = bound(spark, sf_dir, "labs").select("observation_id", F.col("observation_id").alias("sample_id"), F.concat(F.lit("g"), (F.col("observation_id") % 40).cast("string")).alias("gene"), F.concat(F.lit("k"), F.col("isolate_id").cast("string")).alias("linked_key"))
    return linked.expression_links(obs, seen)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "results")


def predicted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bound(spark, sf_dir, "calls").where("call_b IS NOT NULL").groupBy("sample_id", "drug").agg(F.min("call_b").alias("call"))
    return linked.with_predictions(_results(spark, sf_dir).drop("site_id"), p)


def changed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _results(spark, sf_dir).where("phenotypic_call IS NOT NULL").select("sample_id", "drug", "call", "genomic_call")
    after = _results(spark, sf_dir).where("genomic_call <> 'not_assessed'").select("sample_id", "drug", F.when(F.col("site_id") == 0, "indeterminate").otherwise(F.col("call")).alias("call"), "genomic_call")
    return linked.changed_results(before, after, ["sample_id", "drug"], ["call", "genomic_call"])


def discordance_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _results(spark, sf_dir)
    old = results.where("site_id = 1").select(F.sha2(F.concat_ws("|", F.col("site_id").cast("string"), F.col("sample_id").cast("string"), "drug"), 256).alias("ticket_id"))
    return linked.tickets(results, old)


def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bound(spark, sf_dir, "labs").join(bound(spark, sf_dir, "isolates").select("isolate_id", "site_id"), "isolate_id")
    return linked.watch_list(t.select("drug", "isolate_id", "site_id", F.when(F.col("quality") == "pass", "resolved").otherwise("open").alias("status")), 5, 6)


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = bound(spark, sf_dir, "observations").where("variant IS NOT NULL AND phenotype IS NOT NULL").groupBy("variant", "drug", "arrival").agg(F.min("isolate_id").alias("isolate_id"), F.min("site_id").alias("site_id"), F.min("lineage").alias("lineage"), F.min("phenotype").alias("phenotype"))
    records = o.withColumn("result", F.when(F.col("phenotype") == "R", "resistant").otherwise("susceptible"))
    gone = records.select("variant", "drug", (F.col("variant") % 3).cast("int").alias("record_index")).distinct()
    return linked.local_verdicts(records, gone)


def local_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local(spark, sf_dir)


def historical_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("variant"))
    return linked.historical_evidence(v, _local(spark, sf_dir)).groupBy("variant", "drug", "call", "tier", "scope").agg(F.count("*").alias("n_samples"))


def model_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linked.model_verdicts(bound(spark, sf_dir, "performance")))


def frequency_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bound(spark, sf_dir, "variants").where("vaf IS NOT NULL").select("sample_id", "variant_key", (F.col("vaf") / 10).alias("vaf"))
    return rounded(linked.frequency_groups(v, 0.02))


def population_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = frequency_groups(spark, sf_dir)
    hints = groups.select("sample_id", "group", F.when(F.col("sample_id") % 2 == 0, F.concat(F.lit("L"), F.col("size").cast("string"))).otherwise("L1").alias("lineage"))
    return linked.population_class(groups, hints)


def uncertain_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pairs = part.select(F.col("p_partkey").alias("variant"), F.col("p_type").alias("drug"), F.when(F.col("p_size") % 3 == 0, "frameshift").when(F.col("p_size") % 3 == 1, "missense").otherwise("odd").alias("consequence"))
    dims = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("variant"), F.col("l_linenumber").alias("dimension"), F.when(F.col("l_tax") > 0.01, F.col("l_discount") * 15 - 0.2).alias("value"))
    return rounded(linked.uncertain_ranking(pairs, dims, ORDER, 20))


def phenotype_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = bound(spark, sf_dir, "wide")
    long = phenotypes.phenotypes_long(wide, {"rif": "rifampicin", "inh": "isoniazid"}, wide.select("sample_id").limit(0))
    return reports.phenotype_summary(long)


def workflow_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.workflow_arms(bound(spark, sf_dir, "arms"), ["drug", "lineage", "site_id"]))


def paired_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.paired_correctness(bound(spark, sf_dir, "arms"))


def storage_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = bound(spark, sf_dir, "runs").select(F.col("run").alias("sample_id"), F.when(F.col("run") % 9 > 0, F.col("bases")).alias("bases"))
    return reports.storage_estimate(runs, bound(spark, sf_dir, "runs").where("layout = 'SINGLE'").select(F.col("run").alias("sample_id")), (0.25, 0.5, 1.0))


def signal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.signal_gate(bound(spark, sf_dir, "signals"), 40, 3, 20)


def target_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    t = part.select(F.col("p_partkey").alias("target"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 2 == 0).alias("essential"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 5 == 0).alias("human_homolog"))
    return reports.subtractive(t).groupBy("passes").agg(F.count("*").alias("n"))


def external_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = bound(spark, sf_dir, "calls")
    p = calls.select(F.col("sample_id").alias("isolate_id"), "drug", F.when(F.col("call_a") != "not_assessed", F.col("call_a")).alias("predicted"), "confidence")
    t = calls.where("phenotype IS NOT NULL").groupBy(F.col("sample_id").alias("isolate_id"), "drug").agg(F.when(F.min("phenotype") == "R", "resistant").otherwise("susceptible").alias("truth"))
    base = bound(spark, sf_dir, "drugs").select("drug", F.lit(0.3).alias("base_coverage"), F.when(F.col("drug") < "3", 0.9).otherwise(0.1).alias("base_risk"))
    return rounded(reports.external_benchmark(p, t, base))


def prediction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "labs").select("isolate_id", F.when(F.col("observation_id") % 10 > 0, F.col("drug")).alias("drug"), F.when(F.col("observation_id") % 7 == 1, "maybe").otherwise(F.col("result")).alias("predicted"), (F.col("observation_id") % 13 / 10).alias("confidence"))
    return reports.prediction_errors(rows).groupBy("error").agg(F.count("*").alias("n"))


def locus_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    loci = [f"Brand#{k}" for k in range(1, 6)]
    wide = reports.locus_matrix(bound(spark, sf_dir, "coverage").withColumn("callable_fraction", F.col("callable_fraction").cast("double")), loci)
    return rounded(wide.select("isolate_id", *[F.col(f"`{x}`").alias(f"l{x[6:]}") for x in loci]))


def discordant_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.discordant_rows(_results(spark, sf_dir)).select("sample_id", "drug", "genomic_call", "phenotypic_call")


def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bound(spark, sf_dir, "variants").groupBy("sample_id", F.col("variant_key").alias("variant")).agg(F.max("vaf").alias("score")).withColumn("drug", F.lit("d"))
    return rounded(reports.ranked_items(v))


def gene_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.gene_positions(bound(spark, sf_dir, "variants"), 1000))


def mutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = bound(spark, sf_dir, "changes").select("gene", "pos", "ref", "alt")
    b = bound(spark, sf_dir, "variants").select("gene", F.col("pos").cast("long").alias("pos"), F.lit("A").alias("ref"), F.lit("T").alias("alt"))
    return reports.mutation_index(a, b)


def sample_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sample_details(_results(spark, sf_dir), bound(spark, sf_dir, "coverage").withColumnRenamed("isolate_id", "sample_id"))


def headline_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    drugs = reports.pooled_rates(bound(spark, sf_dir, "calls")).select("drug", (F.col("drug") < "5").alias("estimable"), F.col("call_rate").alias("coverage"), "fn")
    return rounded(reports.headline(drugs, _results(spark, sf_dir)))


def accuracy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.accuracy_table(reports.pooled_rates(bound(spark, sf_dir, "calls")), 200))


_LAB = ", lb AS (SELECT *, CASE WHEN mic <= 3 THEN 'susceptible' WHEN mic > 3 THEN 'resistant' END AS mc FROM labs)"
_QC = """, qw AS (SELECT isolate_id, qc_check, MIN(CASE status WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END) AS k FROM qc GROUP BY isolate_id, qc_check),
qe AS (SELECT isolate_id, c AS qc_check FROM isolates CROSS JOIN (VALUES ('species_confirmation'), ('contamination'), ('duplication'), ('insert_size')) AS v(c) UNION SELECT isolate_id, qc_check FROM qw),
qt AS (SELECT e.isolate_id AS isolate_id, e.qc_check AS qc_check, CASE k WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' WHEN 2 THEN 'pass' ELSE 'not_performed' END AS status FROM qe AS e LEFT JOIN qw ON qw.isolate_id = e.isolate_id AND qw.qc_check = e.qc_check)"""
_PANEL = ", pn AS (SELECT DISTINCT p_brand AS locus FROM part WHERE p_size > 25 AND p_brand < 'Brand#3')"
_LOCAL = """, lo AS (SELECT variant, drug, arrival, MIN(isolate_id) AS isolate_id, MIN(site_id) AS site_id, MIN(lineage) AS lineage, MIN(phenotype) AS phenotype FROM observations WHERE variant IS NOT NULL AND phenotype IS NOT NULL GROUP BY variant, drug, arrival),
ln AS (SELECT *, row_number() OVER (PARTITION BY variant, drug ORDER BY arrival) - 1 AS i FROM lo),
lv AS (SELECT variant, drug, CASE WHEN COUNT(DISTINCT phenotype) > 1 THEN 'indeterminate' WHEN MIN(phenotype) = 'R' THEN 'resistant' ELSE 'susceptible' END AS call, COUNT(*) AS n_records, COUNT(DISTINCT isolate_id) AS n_isolates, COUNT(DISTINCT site_id) AS n_sites,
  coalesce(string_agg(DISTINCT lineage, ',' ORDER BY lineage), '') AS lineages FROM ln WHERE i <> variant % 3 GROUP BY variant, drug)"""
_GROUPS = """WITH RECURSIVE vb AS (SELECT DISTINCT sample_id, variant_key, CAST(round(vaf / 10, 6) AS DECIMAL(12, 6)) AS vaf FROM ({variants}) WHERE vaf / 10 BETWEEN 0 AND 1),
vn AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY vaf, variant_key) AS k FROM vb),
vg AS (SELECT sample_id, vaf, vaf AS start, k FROM vn WHERE k = 1 UNION ALL SELECT vn.sample_id, vn.vaf, CASE WHEN vn.vaf - vg.start > CAST(0.02 AS DECIMAL(12, 6)) THEN vn.vaf ELSE vg.start END, vn.k FROM vg JOIN vn ON vn.sample_id = vg.sample_id AND vn.k = vg.k + 1),
gr AS (SELECT sample_id, start, COUNT(*) AS size, quantile_cont(CAST(vaf AS DOUBLE), 0.5) AS m FROM vg GROUP BY sample_id, start HAVING COUNT(*) >= 2)
"""
_ARM_COLUMNS = """COUNT(*) AS n, COUNT(CASE WHEN called THEN 1 END) AS n_called, COUNT(CASE WHEN call = 'resistant' AND truth = 'resistant' THEN 1 END) AS tp, COUNT(CASE WHEN call = 'resistant' AND truth <> 'resistant' THEN 1 END) AS fp, COUNT(CASE WHEN call = 'susceptible' AND truth <> 'resistant' THEN 1 END) AS tn,
  COUNT(CASE WHEN call = 'susceptible' AND truth = 'resistant' THEN 1 END) AS fn, COUNT(CASE WHEN NOT called AND truth = 'resistant' THEN 1 END) AS abstained_r, COUNT(CASE WHEN NOT called AND truth <> 'resistant' THEN 1 END) AS abstained_s"""

QUERIES = {f.__name__: f for f in (
    constraint_violations, unfounded_resistance, screened_runs, discovery_summary, cohort_parts, verified_fields, identity_conflicts, lab_evidence, qc_tables, qc_counts, panel_coverage, panel_gaps, evidence_hashes,
    calibration_lookup, variant_priors, described_isolates, co_observed_pairs, expression_links, predicted_results, changed_results, discordance_tickets, watch_list, local_verdicts, historical_evidence,
    model_verdicts, frequency_groups, population_classes, uncertain_ranking, phenotype_summary, workflow_arms, paired_correctness, storage_estimate, signal_gate, target_filter, external_benchmark, prediction_errors,
    locus_matrix, discordant_results, ranked_items, gene_positions, mutation_index, sample_details, headline_figures, accuracy_table,
)}
SQL = {
    "constraint_violations": with_bindings("runs", """, vi AS (SELECT run, 'platform' AS rule FROM runs WHERE upper(platform) <> 'ILLUMINA' UNION ALL SELECT run, 'layout' FROM runs WHERE layout <> 'PAIRED' UNION ALL SELECT run, 'bases' FROM runs WHERE bases <= 50000
  UNION ALL SELECT run, 'missing biosample' FROM runs WHERE biosample IS NULL UNION ALL SELECT run, 'repeated biosample' FROM runs WHERE biosample IN (SELECT biosample FROM runs GROUP BY biosample HAVING COUNT(*) > 1))
SELECT rule, COUNT(*) AS n, MIN(run) AS first_key FROM vi GROUP BY rule"""),
    "unfounded_resistance": with_bindings("evidence", " SELECT isolate_id, COUNT(*) AS n FROM evidence WHERE call = 'resistant' AND scope = 'variant' GROUP BY isolate_id"),
    "screened_runs": with_bindings("runs", " SELECT run, CASE WHEN upper(platform) <> 'ILLUMINA' THEN 'platform' WHEN layout <> 'PAIRED' THEN 'layout' WHEN biosample IS NULL THEN 'no sample' WHEN organism = '5-LOW' THEN 'organism' END AS reject_reason FROM runs"),
    "discovery_summary": with_bindings("runs", """ SELECT CASE WHEN upper(platform) <> 'ILLUMINA' THEN 'platform' WHEN layout <> 'PAIRED' THEN 'layout' WHEN biosample IS NULL THEN 'no sample' WHEN organism = '5-LOW' THEN 'organism' END AS reject_reason, COUNT(*) AS n, COUNT(DISTINCT organism) AS n_organisms FROM runs GROUP BY 1"""),
    "cohort_parts": with_bindings("runs", " SELECT CASE WHEN trim(coalesce(outcome, '')) <> '' THEN 'control' ELSE 'benchmark' END AS part, COUNT(*) AS n FROM runs GROUP BY 1"),
    "verified_fields": with_bindings("runs", " SELECT run, CASE WHEN run % 8 = 0 THEN 'not found' ELSE concat_ws(',', CASE WHEN run % 5 = 0 THEN 'platform' END, CASE WHEN run % 9 = 0 THEN 'bases' END) END AS errors FROM runs"),
    "identity_conflicts": with_bindings("runs contexts", " SELECT run AS report, c.isolate_id AS isolate_id, 'organism' AS field FROM runs AS r JOIN contexts AS c ON c.isolate_id = r.custkey WHERE run % 3 > 0 AND c.organism <> 'BUILDING'"),
    "lab_evidence": with_bindings("labs", _LAB + """ SELECT observation_id, isolate_id, drug, CASE WHEN quality <> 'pass' THEN 'indeterminate' ELSE result END AS call, 'phenotypic' AS tier,
  concat_ws('; ', CASE WHEN mc <> result THEN 'value and category differ' END, CASE WHEN quality <> 'pass' THEN 'quality' END) AS notes FROM lb"""),
    "qc_tables": with_bindings("isolates qc", _QC + " SELECT * FROM qt"),
    "qc_counts": with_bindings("isolates qc", _QC + " SELECT status, COUNT(*) AS n, status = 'fail' AS blocking FROM qt GROUP BY status"),
    "panel_coverage": with_bindings("coverage", _PANEL + " SELECT locus, locus IN (SELECT locus FROM pn) AS kept, COUNT(*) AS n FROM coverage GROUP BY locus"),
    "panel_gaps": with_bindings("profile", _PANEL + """, pd AS (SELECT drug, locus, CASE WHEN locus NOT IN (SELECT locus FROM pn) THEN locus END AS m FROM profile), pg AS (SELECT drug, COUNT(locus) AS n_loci, coalesce(string_agg(m, ',' ORDER BY m), '') AS missing FROM pd GROUP BY drug)
SELECT * FROM pg WHERE missing <> '' OR n_loci = 0"""),
    "evidence_hashes": with_bindings("labs", " SELECT sha256('v' || CAST(isolate_id AS VARCHAR) || '|v' || drug || '|v' || result || '|v' || quality) AS evidence_id, COUNT(*) AS n FROM labs GROUP BY 1"),
    "calibration_lookup": with_bindings("labs calibrations", """, lr AS (SELECT observation_id, CASE WHEN observation_id % 2 = 0 THEN 'illumina' ELSE 'nanopore' END AS platform, drug, CASE WHEN observation_id % 3 > 0 THEN 'L' || CAST(observation_id % 4 AS VARCHAR) END AS lineage FROM labs)
SELECT lr.*, round(coalesce(o.lod50, w.lod50), 6) + 0.0 AS lod50, CASE WHEN o.lod50 IS NOT NULL THEN 'lineage' WHEN w.lod50 IS NOT NULL THEN 'any' END AS basis FROM lr LEFT JOIN calibrations AS o ON o.platform = lr.platform AND o.drug = lr.drug AND o.lineage = lr.lineage
LEFT JOIN calibrations AS w ON w.platform = lr.platform AND w.drug = lr.drug AND w.lineage = '*'"""),
    "variant_priors": with_bindings("observations", """, kn AS (SELECT *, row_number() OVER (PARTITION BY variant, drug, isolate_id ORDER BY arrival) AS k FROM observations WHERE phenotype IN ('R', 'S') AND variant IS NOT NULL),
pr AS (SELECT variant, drug, COUNT(CASE WHEN phenotype = 'R' THEN 1 END) / CAST(COUNT(*) AS DOUBLE) AS p FROM kn WHERE k = 1 GROUP BY variant, drug HAVING COUNT(*) >= 10)
SELECT o.variant AS variant, o.drug AS drug, round(p, 6) + 0.0 AS prior FROM (SELECT DISTINCT variant, drug FROM observations WHERE variant IS NOT NULL) AS o LEFT JOIN pr ON pr.variant = o.variant AND pr.drug = o.drug"""),
    "described_isolates": with_bindings("isolates metadata", """ SELECT i.isolate_id AS isolate_id, coalesce(CASE WHEN m.patient_id % 3 > 0 THEN 'M' || CAST(m.patient_id % 3 AS VARCHAR) END, i.lineage) AS lineage, coalesce(m.site_id, i.site_id) AS site_id, m.isolate_id IS NOT NULL AS described
FROM isolates AS i LEFT JOIN (SELECT * FROM metadata WHERE cluster_id > 20) AS m ON m.isolate_id = i.isolate_id"""),
    "co_observed_pairs": with_bindings("pair_rules variants", """, sl AS (SELECT DISTINCT sample_id, variant_key, gene AS s FROM variants UNION SELECT sample_id, variant_key, variant_key FROM variants)
SELECT DISTINCT a.sample_id AS sample_id, rule, drug, a.variant_key AS key_a, b.variant_key AS key_b FROM pair_rules AS r JOIN sl AS a ON a.s = r."primary" JOIN sl AS b ON b.s = r.partner AND b.sample_id = a.sample_id WHERE a.variant_key <> b.variant_key AND a.sample_id % 2 = 0 AND drug = 'STANDARD'"""),
    "expression_links": with_bindings("variants labs", """, se AS (SELECT sample_id, gene, variant_key, 'd' || CAST(pos % 3 AS VARCHAR) AS drug FROM variants WHERE region = 'promoter'), ob AS (SELECT observation_id, 'g' || CAST(observation_id % 40 AS VARCHAR) AS gene, 'k' || CAST(isolate_id AS VARCHAR) AS linked FROM labs),
ol AS (SELECT DISTINCT observation_id, drug FROM ob JOIN se ON se.sample_id = ob.observation_id AND (se.gene = ob.gene OR se.variant_key = ob.linked))
SELECT ob.observation_id AS observation_id, ob.observation_id AS sample_id, ob.gene AS gene, coalesce(d, '') AS drugs, CASE WHEN d IS NULL THEN 'unlinked' ELSE 'linked' END AS status FROM ob LEFT JOIN (SELECT observation_id, string_agg(drug, ',' ORDER BY drug) AS d FROM ol GROUP BY observation_id) AS l ON l.observation_id = ob.observation_id"""),
    "predicted_results": with_bindings("results calls", """, pp AS (SELECT r.sample_id AS sample_id, r.drug AS drug, call, genomic_call, phenotypic_call, call_b AS predicted, coalesce(genomic_call IN ('resistant', 'susceptible') AND call_b <> genomic_call, false) AS conflict FROM results AS r LEFT JOIN (SELECT sample_id, drug, MIN(call_b) AS call_b FROM calls WHERE call_b IS NOT NULL GROUP BY sample_id, drug) AS c ON c.sample_id = r.sample_id AND c.drug = r.drug)
SELECT sample_id, drug, CASE WHEN conflict AND NOT coalesce(phenotypic_call IN ('resistant', 'susceptible'), false) THEN 'indeterminate' ELSE call END AS call, genomic_call, phenotypic_call, predicted, conflict FROM pp"""),
    "changed_results": with_bindings("results", """, bf AS (SELECT * FROM results WHERE phenotypic_call IS NOT NULL), af AS (SELECT sample_id, drug, CASE WHEN site_id = 0 THEN 'indeterminate' ELSE call END AS call, genomic_call FROM results WHERE genomic_call <> 'not_assessed')
SELECT coalesce(b.sample_id, a.sample_id) AS sample_id, coalesce(b.drug, a.drug) AS drug, coalesce(b.call, 'absent') AS before, coalesce(a.call, 'absent') AS after, b.call IS NULL OR a.call IS NULL OR b.call <> a.call AS call_changed
FROM bf AS b FULL JOIN af AS a ON a.sample_id = b.sample_id AND a.drug = b.drug WHERE b.call IS NULL OR a.call IS NULL OR a.call <> b.call OR a.genomic_call <> b.genomic_call"""),
    "discordance_tickets": with_bindings("results", """ SELECT sha256(CAST(site_id AS VARCHAR) || '|' || CAST(sample_id AS VARCHAR) || '|' || drug) AS ticket_id, site_id, sample_id, drug, genomic_call, phenotypic_call FROM results
WHERE genomic_call IN ('resistant', 'susceptible') AND phenotypic_call IN ('resistant', 'susceptible') AND genomic_call <> phenotypic_call AND site_id <> 1"""),
    "watch_list": with_bindings("labs isolates", """, wc AS (SELECT drug, COUNT(DISTINCT CAST(site_id AS VARCHAR) || '|' || CAST(l.isolate_id AS VARCHAR)) AS n, COUNT(DISTINCT site_id) AS s FROM labs AS l JOIN isolates AS i ON i.isolate_id = l.isolate_id WHERE quality <> 'pass' GROUP BY drug)
SELECT drug, n >= 5 AND s >= 6 AS released, CASE WHEN n >= 5 AND s >= 6 THEN n END AS unresolved_isolates, CASE WHEN n >= 5 AND s >= 6 THEN s END AS contributing_sites FROM wc"""),
    "local_verdicts": with_bindings("observations", _LOCAL + " SELECT * FROM lv"),
    "historical_evidence": with_bindings("observations", _LOCAL + " SELECT v.variant AS variant, drug, 'indeterminate' AS call, 'inferred' AS tier, 'historical' AS scope, COUNT(*) AS n_samples FROM (SELECT DISTINCT l_orderkey, l_partkey AS variant FROM lineitem) AS v JOIN lv ON lv.variant = v.variant GROUP BY v.variant, drug"),
    "model_verdicts": with_bindings("performance", """, mv AS (SELECT model, drug, round(call_rate, 6) + 0.0 AS call_rate, round(error_rate, 6) + 0.0 AS error_rate, round(base_coverage, 6) + 0.0 AS base_coverage, round(base_error, 6) + 0.0 AS base_error,
  CASE WHEN call_rate < base_coverage THEN 'answers less' WHEN error_rate = base_error THEN 'matches' WHEN error_rate >= base_error THEN 'errs more' END AS reason, coalesce(call_rate >= base_coverage AND error_rate < base_error, false) AS beats FROM performance)
SELECT *, bool_and(beats) OVER (PARTITION BY model) AS all_beat FROM mv"""),
    "phenotype_summary": with_bindings("wide", """, ln AS (SELECT run, 'rifampicin' AS drug, upper(nullif(trim(rif_phenotype), '')) AS p, coalesce(upper(trim(rif_quality)), '') AS q, nullif(trim(rif_mic), '') AS m FROM wide UNION ALL SELECT run, 'isoniazid', upper(nullif(trim(inh_phenotype), '')), coalesce(upper(trim(inh_quality)), ''), nullif(trim(inh_mic), '') FROM wide),
ev AS (SELECT *, coalesce(p IN ('R', 'S') AND q = 'HIGH', false) AS e FROM ln WHERE run <> 'NONE' AND (p IS NOT NULL OR m IS NOT NULL))
SELECT drug, COUNT(*) AS n, COUNT(CASE WHEN e THEN 1 END) AS n_evaluable, COUNT(CASE WHEN e AND p = 'R' THEN 1 END) AS n_r, COUNT(CASE WHEN e AND p = 'S' THEN 1 END) AS n_s FROM ev GROUP BY drug"""),
    "workflow_arms": with_bindings("arms", f""", lg AS (SELECT 'baseline' AS arm, truth, baseline_call AS call, drug, coalesce(lineage, 'unknown') AS lineage, CAST(site_id AS VARCHAR) AS site FROM arms UNION ALL SELECT 'intervention', truth, intervention_call, drug, coalesce(lineage, 'unknown'), CAST(site_id AS VARCHAR) FROM arms),
lc AS (SELECT *, coalesce(call IN ('resistant', 'susceptible'), false) AS called FROM lg),
gs AS (SELECT arm, 'all' AS stratum, NULL AS value, {_ARM_COLUMNS} FROM lc GROUP BY arm UNION ALL SELECT arm, 'drug', drug, {_ARM_COLUMNS} FROM lc GROUP BY arm, drug UNION ALL SELECT arm, 'lineage', lineage, {_ARM_COLUMNS} FROM lc GROUP BY arm, lineage UNION ALL SELECT arm, 'site_id', site, {_ARM_COLUMNS} FROM lc GROUP BY arm, site)
SELECT *, round(n_called / CAST(n AS DOUBLE), 6) + 0.0 AS call_rate, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) + 0.0 AS conditional_sensitivity, round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 6) + 0.0 AS conditional_specificity,
  round(CAST(tp AS DOUBLE) / nullif(tp + fn + abstained_r, 0), 6) + 0.0 AS resistant_yield, round(CAST(tn AS DOUBLE) / nullif(tn + fp + abstained_s, 0), 6) + 0.0 AS susceptible_yield FROM gs"""),
    "paired_correctness": with_bindings("arms", """, pc AS (SELECT coalesce(baseline_call = truth, false) AS b, coalesce(intervention_call = truth, false) AS a FROM arms) SELECT CASE WHEN a AND NOT b THEN 'improved' WHEN b AND NOT a THEN 'worsened' ELSE 'unchanged' END AS change, COUNT(*) AS n FROM pc GROUP BY 1"""),
    "storage_estimate": with_bindings("runs", """, pe AS (SELECT layout = 'SINGLE' AS p, CASE WHEN run % 9 > 0 THEN bases END AS b FROM runs) SELECT COUNT(CASE WHEN p THEN 1 END) AS n_present, COUNT(CASE WHEN NOT p THEN 1 END) AS n_pending, COUNT(CASE WHEN NOT p AND b IS NULL THEN 1 END) AS n_unknown,
  CAST(round(SUM(CASE WHEN NOT p THEN b END) * CAST(0.25 AS DOUBLE)) AS BIGINT) AS bytes_low, CAST(round(SUM(CASE WHEN NOT p THEN b END) * CAST(0.5 AS DOUBLE)) AS BIGINT) AS bytes_mid, CAST(SUM(CASE WHEN NOT p THEN b END) AS BIGINT) AS bytes_high FROM pe"""),
    "signal_gate": with_bindings("signals", """, sg AS (SELECT drug, string_agg(gene, ',' ORDER BY gene) AS genes FROM (SELECT drug, gene FROM signals WHERE resistant AND NOT explained AND gene IS NOT NULL GROUP BY drug, gene HAVING COUNT(DISTINCT isolate_id) >= 2) GROUP BY drug),
sn AS (SELECT s.drug AS drug, COUNT(DISTINCT isolate_id) AS n_isolates, COUNT(DISTINCT site_id) AS n_sites, COUNT(DISTINCT CASE WHEN resistant AND NOT explained THEN isolate_id END) AS n_unexplained FROM signals AS s GROUP BY s.drug),
sr AS (SELECT sn.*, coalesce(genes, '') AS genes, concat_ws(',', CASE WHEN n_isolates < 40 THEN 'isolates' END, CASE WHEN n_sites < 3 THEN 'sites' END, CASE WHEN n_unexplained < 20 THEN 'unexplained' END, CASE WHEN genes IS NULL THEN 'no convergent gene' END) AS reasons FROM sn LEFT JOIN sg ON sg.drug = sn.drug)
SELECT *, reasons = '' AS passes FROM sr"""),
    "target_filter": " SELECT CASE WHEN p_size % 3 > 0 THEN p_size % 2 = 0 END AND NOT CASE WHEN p_size % 4 > 0 THEN p_size % 5 = 0 END AS passes, COUNT(*) AS n FROM part GROUP BY 1",
    "prediction_errors": with_bindings("labs", """, pe AS (SELECT isolate_id, CASE WHEN observation_id % 10 > 0 THEN drug END AS drug, CASE WHEN observation_id % 7 = 1 THEN 'maybe' ELSE result END AS p, observation_id % 13 / CAST(10 AS DOUBLE) AS c FROM labs),
ea AS (SELECT CASE WHEN drug IS NULL THEN 'missing key' WHEN p = 'maybe' THEN 'unknown value' WHEN c > 1 THEN 'confidence outside 0..1' END AS error FROM pe UNION ALL SELECT 'repeated' FROM pe GROUP BY isolate_id, drug HAVING COUNT(*) > 1)
SELECT error, COUNT(*) AS n FROM ea WHERE error IS NOT NULL GROUP BY error"""),
    "locus_matrix": with_bindings("coverage", " SELECT isolate_id, " + ", ".join(f"round(MAX(CASE WHEN locus = 'Brand#{k}' THEN CAST(callable_fraction AS DOUBLE) END), 6) + 0.0 AS l{k}" for k in range(1, 6)) + " FROM coverage GROUP BY isolate_id"),
    "discordant_results": with_bindings("results", " SELECT sample_id, drug, genomic_call, phenotypic_call FROM results WHERE genomic_call <> phenotypic_call"),
    "ranked_items": with_bindings("variants", """, it AS (SELECT sample_id, variant_key AS variant, MAX(vaf) AS score FROM variants GROUP BY sample_id, variant_key)
SELECT sample_id, variant, round(score, 6) + 0.0 AS score, 'd' AS drug, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY score DESC NULLS LAST, variant) AS INTEGER) AS place FROM it"""),
    "gene_positions": with_bindings("variants", """ SELECT gene, pos, COUNT(DISTINCT sample_id) AS carriers, round(AVG(vaf), 6) + 0.0 AS mean_vaf, string_agg(DISTINCT consequence, ',' ORDER BY consequence) AS consequences, string_agg(DISTINCT region, ',' ORDER BY region) AS regions,
  list_sort(list(depth))[CAST(COUNT(depth) // 2 + 1 AS BIGINT)] AS median_depth, round(COUNT(DISTINCT sample_id) / CAST(1000 AS DOUBLE), 6) + 0.0 AS carrier_fraction FROM variants GROUP BY gene, pos"""),
    "mutation_index": with_bindings("changes variants", " SELECT gene, pos, ref, alt FROM changes UNION SELECT gene, pos, 'A', 'T' FROM variants"),
    "sample_details": with_bindings("results coverage", """, sc AS (SELECT sample_id, string_agg(drug || '=' || call, ';' ORDER BY drug || '=' || call) AS calls FROM results GROUP BY sample_id), sv AS (SELECT isolate_id, COUNT(*) AS n_loci, COUNT(CASE WHEN callable_fraction >= 0.95 THEN 1 END) AS n_callable FROM coverage GROUP BY isolate_id)
SELECT sc.sample_id AS sample_id, calls, n_loci, n_callable FROM sc LEFT JOIN sv ON sv.isolate_id = sc.sample_id"""),
    "headline_figures": with_bindings("calls results", """, ek AS (SELECT drug, COUNT(CASE WHEN call_a = 'susceptible' AND phenotype = 'R' THEN 1 END) AS fn, COUNT(CASE WHEN call_a IN ('resistant', 'susceptible') THEN 1 END) / CAST(COUNT(*) AS DOUBLE) AS c FROM calls WHERE phenotype IN ('R', 'S') GROUP BY drug),
ho AS (SELECT list_sort(list(c)) AS l, CAST(SUM(fn) AS BIGINT) AS fn, COUNT(*) AS n FROM ek WHERE drug < '5')
SELECT (SELECT COUNT(*) FROM ek) AS n_drugs, n AS n_estimable, fn AS very_major_errors, round(l[CAST(n // 2 + 1 AS BIGINT)], 6) + 0.0 AS median_coverage, (SELECT COUNT(*) FROM results) AS n_calls, (SELECT COUNT(*) FROM results WHERE call = 'susceptible') AS n_susceptible,
  (SELECT COUNT(*) FROM results WHERE call = 'not_assessed') AS n_not_assessed FROM ho"""),
}
SQL["frequency_groups"] = _GROUPS.format(variants=BINDINGS["variants"]) + "SELECT sample_id, round(CAST(start AS DOUBLE), 6) + 0.0 AS \"group\", size, round(m, 6) + 0.0 AS median_vaf FROM gr"
SQL["population_classes"] = _GROUPS.format(variants=BINDINGS["variants"]) + """, hn AS (SELECT sample_id, size, CASE WHEN sample_id % 2 = 0 THEN 'L' || CAST(size AS VARCHAR) ELSE 'L1' END AS lineage FROM gr)
SELECT sample_id, COUNT(*) AS n_groups, COUNT(DISTINCT lineage) AS n_lineages, CASE WHEN COUNT(DISTINCT lineage) >= 2 THEN 'possible_coinfection' ELSE 'indeterminate' END AS classification FROM hn GROUP BY sample_id"""
SQL["uncertain_ranking"] = """WITH dm AS (SELECT l_partkey, COUNT(*) AS n, AVG(least(1.0, greatest(0.0, l_discount * 15 - 0.2))) AS m FROM lineitem WHERE l_tax > 0.01 GROUP BY l_partkey),
pr AS (SELECT p_partkey AS variant, p_type AS drug, CASE p_size % 3 WHEN 0 THEN 'frameshift' WHEN 1 THEN 'missense' ELSE 'odd' END AS consequence, coalesce(n, 0) AS n_dimensions, CASE WHEN n >= 20 THEN round(m, 3) END AS score FROM part LEFT JOIN dm ON l_partkey = p_partkey)
SELECT variant, drug, consequence, n_dimensions, round(score, 6) + 0.0 AS score, CASE WHEN score IS NULL THEN 'insufficient-data' WHEN score >= 0.66 THEN 'high' WHEN score >= 0.33 THEN 'moderate' ELSE 'low' END AS priority, CASE consequence WHEN 'frameshift' THEN 1 WHEN 'missense' THEN 3 ELSE 7 END AS triage FROM pr"""
_RATED = """, rk AS (SELECT drug, COUNT(*) AS n_evaluable, COUNT(CASE WHEN call_a IN ('resistant', 'susceptible') THEN 1 END) AS c, CAST(COUNT(CASE WHEN call_a = 'resistant' AND phenotype = 'R' THEN 1 END) AS DOUBLE) AS tp, CAST(COUNT(CASE WHEN call_a = 'resistant' AND phenotype = 'S' THEN 1 END) AS DOUBLE) AS fp,
  CAST(COUNT(CASE WHEN call_a = 'susceptible' AND phenotype = 'S' THEN 1 END) AS DOUBLE) AS tn, CAST(COUNT(CASE WHEN call_a = 'susceptible' AND phenotype = 'R' THEN 1 END) AS DOUBLE) AS fn FROM calls WHERE phenotype IN ('R', 'S') GROUP BY drug)"""
SQL["accuracy_table"] = with_bindings("calls", _RATED + """ SELECT drug, n_evaluable, n_evaluable >= 200 AS estimable, CASE WHEN n_evaluable >= 200 THEN round(tp / nullif(tp + fn, 0), 6) + 0.0 END AS sensitivity, CASE WHEN n_evaluable >= 200 THEN round(tn / nullif(tn + fp, 0), 6) + 0.0 END AS specificity,
  CASE WHEN n_evaluable >= 200 THEN round(fn / nullif(tp + fn, 0), 6) + 0.0 END AS vme_rate, CASE WHEN n_evaluable >= 200 THEN round(fp / nullif(tn + fp, 0), 6) + 0.0 END AS me_rate, CASE WHEN n_evaluable >= 200 THEN round(c / CAST(n_evaluable AS DOUBLE), 6) + 0.0 END AS call_rate FROM rk""")
SQL["external_benchmark"] = with_bindings("calls drugs", """, pr AS (SELECT c.drug AS drug, CASE WHEN call_a <> 'not_assessed' THEN call_a END AS predicted, truth, confidence FROM calls AS c LEFT JOIN (SELECT sample_id, drug, CASE MIN(phenotype) WHEN 'R' THEN 'resistant' ELSE 'susceptible' END AS truth FROM calls WHERE phenotype IS NOT NULL GROUP BY sample_id, drug) AS t ON t.sample_id = c.sample_id AND t.drug = c.drug),
lv AS (SELECT drug, confidence AS t, COUNT(*) AS n, COUNT(CASE WHEN predicted <> truth THEN 1 END) AS w FROM pr WHERE predicted IS NOT NULL AND truth IS NOT NULL GROUP BY drug, confidence),
rk AS (SELECT drug, t, row_number() OVER (PARTITION BY drug ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY drug) AS m, sum(n) OVER (PARTITION BY drug ORDER BY t DESC) AS k, sum(w) OVER (PARTITION BY drug ORDER BY t DESC) AS e FROM lv),
ct AS (SELECT drug, COUNT(truth) AS n_joined, COUNT(CASE WHEN truth IS NULL THEN 1 END) AS n_dropped, COUNT(CASE WHEN truth IS NOT NULL THEN predicted END) AS n_answered, COUNT(CASE WHEN predicted <> truth THEN 1 END) AS n_errors FROM pr GROUP BY drug),
cv AS (SELECT rk.drug AS drug, CAST(k AS DOUBLE) / n_joined AS c, CASE WHEN k >= 10 THEN CAST(e AS DOUBLE) / k END AS r FROM rk JOIN ct ON ct.drug = rk.drug WHERE i % greatest(1, m // 49) = 0 OR i = m - 1),
mt AS (SELECT drug, c, r, row_number() OVER (PARTITION BY drug ORDER BY c) AS k FROM cv WHERE c >= 0.3),
bs AS (SELECT drug, CASE WHEN drug < '3' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS b FROM drugs)
SELECT ct.drug AS drug, n_joined, n_dropped, n_answered, n_errors, CAST(0.3 AS DOUBLE) AS base_coverage, b AS base_risk, round(c, 6) + 0.0 AS matched_coverage, round(r, 6) + 0.0 AS matched_risk, CASE WHEN c IS NULL THEN 'cannot-match-coverage' WHEN r IS NULL THEN 'underpowered' WHEN r < b THEN 'beats-baseline' ELSE 'no-better-than-baseline' END AS verdict,
  round(n_answered / CAST(n_joined AS DOUBLE), 6) + 0.0 AS coverage, CASE WHEN n_answered >= 10 THEN round(n_errors / CAST(n_answered AS DOUBLE), 6) + 0.0 END AS error_rate FROM ct LEFT JOIN mt ON mt.drug = ct.drug AND k = 1 LEFT JOIN bs ON bs.drug = ct.drug""")
