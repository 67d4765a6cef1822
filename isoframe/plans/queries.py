"""The registered queries of the evidence and cohort operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions import alleles, measures
from isoframe.operators import accuracy, catalogue, censored, coverage, effects, evidence, federated, fingerprints, ledger, selective, strata, testing, views, workflow
from isoframe.operators.joins import spread
from isoframe.plans import effect_scan, follow_ups, loads, report_views, streams, tool_outputs, variant_lanes, shown_views
from isoframe.plans.bindings import BINDINGS, bound, order_lines, rounded
from isoframe.sources import phenotypes, vcf
from isoframe.sources.scratch import shared_path, stored
from isoframe.streaming import monitoring

#: Targets of the bound drugs: sensitivity, specificity, call rate, evaluable rows. One drug has none.
TARGET_ROWS = [
    ("1-URGENT", 0.95, 0.98, 0.95, 30), ("2-HIGH", 0.40, 0.45, 0.60, 30), ("3-MEDIUM", 0.45, 0.40, 0.60, 1000000), ("4-NOT SPECIFIED", 0.55, 0.30, 0.60, 20),
]
DRUGS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def accuracy_by_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = accuracy.confusion_by_lineage(bound(spark, sf_dir, "calls"))
    return rounded(accuracy.with_intervals(accuracy.with_rates(counts)))


def accuracy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = accuracy.with_rates(accuracy.confusion(bound(spark, sf_dir, "calls"), ["drug"]))
    return accuracy.verdicts(rates, accuracy.targets(spark, TARGET_ROWS)).select("drug", "n_evaluable", "verdict", "reasons")


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy_verdicts(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


def engine_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(accuracy.concordance(bound(spark, sf_dir, "calls")))


def aligned_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = bound(spark, sf_dir, "calls")
    a = calls.where("call_a <> 'not_assessed'").select("sample_id", "drug", F.col("call_a").alias("call"))
    b = calls.where("call_b IS NOT NULL").select("sample_id", "drug", F.col("call_b").alias("call"))
    return rounded(accuracy.concordance(accuracy.aligned(a, b)))


def engine_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = spread(bound(spark, sf_dir, "calls").select("sample_id", "drug", "call_a", "call_b"), order_lines(spark, sf_dir), "sample_id", "drug")
    long = calls.select("sample_id", "drug", F.explode(F.array("call_a", "call_b")).alias("call"))
    return accuracy.engine_agreement(long).groupBy("drug", "state").agg(F.count("*").alias("n"))


def species_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.species_control(bound(spark, sf_dir, "calls"))


def call_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(accuracy.call_distribution(bound(spark, sf_dir, "calls")))


def call_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = accuracy.call_matrix(bound(spark, sf_dir, "calls"), DRUGS)
    return wide.select("sample_id", *[F.col(f"`{d}`").alias(f"drug_{d[0]}") for d in DRUGS])


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = bound(spark, sf_dir, "calls")
    called = F.when(F.col("call_a") != "not_assessed", F.col("call_a"))
    truth = F.when(F.col("phenotype") == "R", "resistant").when(F.col("phenotype") == "S", "susceptible")
    return calls.select("drug", called.alias("predicted"), truth.alias("truth"), "confidence").where("truth IS NOT NULL")


def risk_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selective.curve(_predictions(spark, sf_dir)))


def risk_coverage_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selective.area(selective.curve(_predictions(spark, sf_dir))))


def matched_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.createDataFrame([(d, 0.1 + 0.2 * k, 0.5) for k, d in enumerate(DRUGS)], "drug string, base_coverage double, base_risk double")
    return rounded(selective.against_baseline(selective.curve(_predictions(spark, sf_dir)), base))


def mic_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(censored.parsed(bound(spark, sf_dir, "raw_mic")))


def _mic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return censored.log2_bounds(censored.parsed(bound(spark, sf_dir, "raw_mic")))


def censoring_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(censored.profile(_mic(spark, sf_dir), ["drug"]).drop("reason"))


def censored_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(censored.median(_mic(spark, sf_dir), ["drug"]).select("drug", "n", "median_log2", "reason"))


def _shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriers against others of every label per drug and site, the background left aside."""
    placed = _mic(spark, sf_dir).join(bound(spark, sf_dir, "isolates"), "isolate_id").select("isolate_id", "drug", F.lit("").alias("background"), F.lit("").alias("lineage"), "site_id")
    carriage = bound(spark, sf_dir, "carriage")
    pairs = carriage.select("label").distinct().crossJoin(F.broadcast(spark.createDataFrame([(d,) for d in DRUGS], "drug string")))
    bins = effects.stratum_bins(placed, _mic(spark, sf_dir).select("isolate_id", "drug", "log2_bound", "censoring"), carriage, pairs)
    return effects.stratum_shifts(stored(bins, "bins")).drop("background", "lineage")


def censored_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_shifts(spark, sf_dir))


def pooled_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(censored.pooled(_shifts(spark, sf_dir), ["label", "drug"]))


def holm_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.holm(bound(spark, sf_dir, "pvalues").withColumn("p", F.col("p").cast("double"))))


def discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bound(spark, sf_dir, "pvalues").withColumn("p", F.col("p").cast("double"))
    return testing.benjamini_hochberg(p, alpha=0.9).select("pair_id", "survives")


def federated_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(federated.gates(federated.associations(bound(spark, sf_dir, "observations")), min_n=5, min_fraction=0.4, min_lineages=3))


def disclosure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federated.small_cells(bound(spark, sf_dir, "observations"))


def small_cell_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federated.suppressed(bound(spark, sf_dir, "observations"), min_isolates=7)


def study_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(federated.dependence(bound(spark, sf_dir, "cohort"), "project", ["tier"]))


def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federated.summary(bound(spark, sf_dir, "cohort"), ["project", "organism", "tier"], "bases")


def site_discordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federated.discordance(bound(spark, sf_dir, "site_calls"))


def latest_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = bound(spark, sf_dir, "observations").select("isolate_id", "drug", "arrival", "phenotype").distinct()
    return federated.first_wins(obs, ["isolate_id", "drug"], "arrival", latest=True)


def drift_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    for_drift = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    return rounded(federated.drift(for_drift, ["event_type", "day"], baseline=50.0, tolerance=1.0, min_points=60))


def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir).select("drug", F.col("confidence").alias("p"), (F.col("truth") == "resistant").alias("truth"))
    return rounded(federated.calibration_error(p, ["drug"]))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of entries for each user, in which some entries are altered, cut out, repeated or linked wrongly."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.concat("event_type", F.lit(":"), "props").alias("payload"))
    entries = ledger.append_entries(events, "user_id", "event_id", "payload")
    place = F.col("user_id") * 31 + F.col("seq")
    spoiled = entries.withColumn("entry_hash", F.when(place % 17 == 3, F.sha2("payload", 256)).otherwise(F.col("entry_hash"))).withColumn("prev_hash", F.when(place % 23 == 7, "x").otherwise(F.col("prev_hash")))
    times = F.when(place % 29 == 11, F.array()).when(place % 37 == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return spoiled.withColumn("_t", F.explode(times.cast("array<int>"))).drop("_t")


def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type")
    return ledger.append_entries(events, "user_id", "event_id", "event_type")


def ledger_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.verify(_ledger(spark, sf_dir), ["user_id"])


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.col("event_type").alias("action"), F.when(F.col("value") > 5, "r").alias("reviewer"))
    allowed = {"start": ["signup", "view"], "signup": ["view", "click"], "view": ["click", "purchase", "view"], "click": ["purchase", "view"], "purchase": ["view"], "error": ["view"]}
    return ledger.replay(events, allowed, "user_id", "event_id", "action", ("reviewer",))


def ticket_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir)


def ticket_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.states(_replayed(spark, sf_dir), "user_id", "event_id", "action")


def _vcf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "vcf")
    line = F.concat_ws("\t", F.lit("chr"), F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), "filter", F.lit("."), F.lit("GT:DP"), F.concat("gt", F.lit(":10")))
    return rows.select("file", line.alias("value"))


def genotype_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = bound(spark, sf_dir, "coordinates")
    return vcf.matched(vcf.alleles(vcf.candidates(_vcf_text(spark, sf_dir), catalogue)), catalogue)


def carriers_per_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotype_match(spark, sf_dir).where("carried").groupBy("label").agg(F.count_distinct("file").alias("n_carriers"))


def scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.alleles(vcf.sites(_vcf_text(spark, sf_dir))).groupBy("status").agg(F.count("*").alias("n_alleles"), F.count(F.when(F.col("carried"), 1)).alias("n_carried"))


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one sample; the header of some names two."""
    text, catalogue = _vcf_text(spark, sf_dir), bound(spark, sf_dir, "coordinates")
    names = F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta"), F.when(F.col("file").cast("long") % 7 == 3, "\tb").otherwise(""))
    whole = vcf.single_sample(text.unionByName(text.select("file").distinct().select("file", names.alias("value"))))
    found = vcf.matched(vcf.alleles(vcf.candidates(whole, catalogue)), catalogue)
    return rounded(vcf.load_summary(vcf.alleles(vcf.sites(whole)), found))


def trimmed_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "vcf").where("kind = 1").select("pos", "ref", F.explode(F.split("alt", ",")).alias("alt")).distinct()
    return rows.withColumn("t", alleles.trimmed(F.col("pos"), F.col("ref"), F.col("alt"))).select("pos", "ref", "alt", F.col("t.pos").alias("new_pos"), F.col("t.ref").alias("new_ref"), F.col("t.alt").alias("new_alt"))


def gvcf_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = bound(spark, sf_dir, "blocks").withColumnRenamed("stop", "end")
    return rounded(coverage.from_blocks(blocks, bound(spark, sf_dir, "spans").withColumnRenamed("stop", "end"), ["chrom"], floor=10))


def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "coverage")
    two = rows.withColumn("source", F.lit("a")).withColumn("callable_fraction", F.when(F.col("mean_depth") % 3 > 0, F.col("callable_fraction").cast("double")))
    two = two.unionByName(rows.withColumn("source", F.lit("b")).withColumn("callable_fraction", F.lit(0.9)))
    return rounded(coverage.best_source(two.select("isolate_id", "locus", "callable_fraction", "source"), ["isolate_id", "locus"]))


def required_loci_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.required_loci(bound(spark, sf_dir, "isolates"), bound(spark, sf_dir, "profile"), bound(spark, sf_dir, "coverage"), min_fraction=0.75)


def locus_callability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coverage.locus_callability(bound(spark, sf_dir, "coverage"), 0.8))


def reconciled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.reconcile(bound(spark, sf_dir, "evidence"), required_loci_gate(spark, sf_dir), scope_permits(spark, sf_dir))


def scope_permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.permits(bound(spark, sf_dir, "scopes"), bound(spark, sf_dir, "contexts"), bound(spark, sf_dir, "qc"))


def regimen_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = bound(spark, sf_dir, "profile").select("drug").distinct().select(F.explode(F.array(F.lit("all"), F.when(F.col("drug") < "M", "first"))).alias("regimen"), "drug").where("regimen IS NOT NULL")
    members = members.withColumn("min_required", F.when(F.col("regimen") == "all", 2).otherwise(1))
    return evidence.regimens(reconciled_calls(spark, sf_dir), members)


def strata_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    carriage, determinants = bound(spark, sf_dir, "carriage"), bound(spark, sf_dir, "determinants")
    placed = strata.background(bound(spark, sf_dir, "isolates"), carriage, determinants)
    return strata.carriers(placed, carriage, carriage.join(bound(spark, sf_dir, "determinants").select("label").distinct(), "label", "left_anti").select("label").distinct(), determinants)


def determinant_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    carriage = bound(spark, sf_dir, "carriage")
    return rounded(strata.cooccurrence(carriage, carriage.join(bound(spark, sf_dir, "determinants").select("label").distinct(), "label", "left_anti").select("label").distinct(), bound(spark, sf_dir, "determinants")))


def phenotypes_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = bound(spark, sf_dir, "wide")
    return phenotypes.phenotypes_long(wide, {"rif": "rifampicin", "inh": "isoniazid"}, bound(spark, sf_dir, "isolates").where("lineage IS NULL").select(F.col("isolate_id").alias("sample_id")))


def monitoring_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, ingested twice: the second time changes nothing."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    table = shared_path(spark, "monitoring")
    for delivery in ("first", "again"):
        spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").createOrReplaceTempView("events")
        monitoring.ingest(spark.sql(BINDINGS["stream_rows"]), table, shared_path(spark, "stream"), delivery).awaitTermination()
    return monitoring.totals(spark.read.parquet(table))


def event_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitoring.trend(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], "6 hours")
    return rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")))


def catalogue_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.ingest(bound(spark, sf_dir, "master"))


def catalogue_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.skipped(bound(spark, sf_dir, "master"))


def generalizability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.generalizability(bound(spark, sf_dir, "calls"))


def population_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = bound(spark, sf_dir, "calls").withColumn("site", F.col("site_id").cast("string"))
    return rounded(views.prevalence(calls, ["drug", "lineage", "site"]))


def tier_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.composition(bound(spark, sf_dir, "evidence"), "drug", "tier"))


def isolate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.seeded_sample(bound(spark, sf_dir, "isolates"), "isolate_id", 40, 7)


def validation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bound(spark, sf_dir, "pvalues").withColumn("p", F.col("p").cast("double"))
    verdict = F.when(F.col("pair_id") % 3 == 0, "evidence-of-effect").when(F.col("pair_id") % 3 == 1, "no-evidence").otherwise("confounded")
    scan = testing.benjamini_hochberg(p, alpha=0.9).withColumns({"delta": (F.col("pair_id") * 13 % 200 - 100) / 100.0, "verdict": verdict})
    return rounded(views.validation_queue(scan.select("pair_id", "survives", "delta", "verdict")))


def predictions_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = bound(spark, sf_dir, "calls")
    truths = calls.where("phenotype IS NOT NULL").select("sample_id", "drug", F.col("phenotype").alias("truth"))
    return views.with_truth(calls.select("sample_id", "drug", "call_a"), truths, ["sample_id", "drug"])


def cohort_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(bound(spark, sf_dir, "cohort"), ["sample_id", "project", "tier", "organism", "bases"])


def concentration_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    mic = censored.parsed(bound(spark, sf_dir, "raw_mic")).where("mic_value IS NOT NULL")
    inclusive = F.when(F.col("isolate_id") % 3 == 0, True).when(F.col("isolate_id") % 3 == 1, False)
    critical = F.when(F.col("drug") < "3", 1.0).otherwise(4.0)
    return mic.select("isolate_id", "drug", "mic", measures.concentration_call(F.col("mic_value"), F.col("censoring"), critical, inclusive).alias("call"))


def minority_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("vaf"), F.col("l_tax").alias("false_rate"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") * 3).alias("n"))
    prior = F.when(F.col("l_orderkey") % 11 > 0, (F.col("l_orderkey") % 11 - 1) / 8.0)
    p = measures.posterior(measures.detection_probability(F.col("vaf"), F.lit(0.05), F.lit(60.0)), prior, F.col("false_rate"), F.col("n"))
    return rounded(rows.select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", "p.probability", "p.low", "p.high"))


def paired_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = workflow.paired_change(bound(spark, sf_dir, "paired"), ["minutes", "cost"], {"cost": "currency"})
    return df.select("measure", "unit", "n_pairs", *[(F.round(c, 4) + 0.0).alias(c) for c in ("mean_change", "median_change")])


def submission_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = F.col("ts") - F.make_interval(hours=F.col("event_id") % 40 - 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("submission_id"), (F.col("event_id") * 7 % 1500).alias("nonce"), F.col("ts").alias("received"), sent.alias("sent"))
    return workflow.checked_submissions(events).select("submission_id", "nonce", "reject_reason")


def scan_finalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bound(spark, sf_dir, "pvalues").withColumn("p", F.col("p").cast("double") / 100)
    verdict = F.when(F.col("pair_id") % 3 == 0, "evidence-of-effect").otherwise("no-evidence")
    return workflow.finalised(p.withColumn("verdict", verdict), 0.1).groupBy("verdict", "survives").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    accuracy_by_lineage, accuracy_verdicts, verdict_counts, engine_concordance, aligned_concordance, engine_agreement, species_control, call_distribution,
    call_matrix, risk_coverage_curve, risk_coverage_area, matched_coverage, mic_parsed, censoring_profile, censored_median, censored_shift, pooled_shift,
    holm_adjusted, discoveries, federated_associations, disclosure_check, small_cell_suppression, study_dependence, cohort_summary, site_discordance,
    latest_call, drift_state, calibration_error, ledger_entries, ledger_links, ticket_replay, ticket_states, scope_permits, genotype_match, carriers_per_variant, scan_status, load_summary, trimmed_alleles, gvcf_coverage, coverage_merge,
    required_loci_gate, locus_callability, reconciled_calls, regimen_eligibility, strata_carriers, determinant_cooccurrence, phenotypes_long,
    monitoring_totals, event_trend, catalogue_entries, catalogue_skipped, generalizability, population_prevalence, tier_composition, isolate_sample,
    validation_queue, predictions_with_truth, cohort_fingerprint, concentration_calls, minority_posteriors, paired_change, submission_checks,
    scan_finalised,
)} | effect_scan.QUERIES | tool_outputs.QUERIES | variant_lanes.QUERIES | report_views.QUERIES | streams.QUERIES | follow_ups.QUERIES | loads.QUERIES | shown_views.QUERIES
