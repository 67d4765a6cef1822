"""Queries of tool outputs, coverage sources, variant names and the catalogue baseline, with their SQL.

Files are made from the given tables as texts, so that loaders parse what tools write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions import variants
from isoframe.operators import accuracy, baseline
from isoframe.plans.bindings import bound, rounded, with_bindings
from isoframe.sources import coverage_tables, tools

COLLATE = {"standard": "standard", "economy": "economy", "medium": None, "promo": "promo", "large": None, "small": "small"}


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "findings")


def _graded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One results file a sample, in either of two layouts; some files are broken or lack their list."""
    s = F.col("sample")
    drug = lambda name: F.array(F.struct(F.col("drug"), F.col("grade").alias(name)))
    old = F.struct(F.col("gene").alias("gene_name"), F.col("change").alias("protein_change"), "freq", "depth", drug("who_confidence").alias("drugs"))
    new = F.struct("gene", "change", "freq", "depth", drug("confidence").alias("drugs"))
    gene = F.struct("gene", (F.col("freq") * F.when(s % 3 == 0, 1000).otherwise(1)).alias("fraction"), F.col("depth").alias("median_depth"))
    files = _findings(spark, sf_dir).groupBy("sample").agg(F.collect_list(new).alias("new"), F.collect_list(old).alias("old"), F.collect_list(gene).alias("genes"))
    later = F.to_json(F.struct(s.cast("string").alias("id"), F.col("new").alias("dr_variants"), F.struct(F.col("genes").alias("gene_coverage")).alias("qc")))
    earlier = F.to_json(F.struct(s.cast("string").alias("sample_name"), F.col("old").alias("drug_resistance_variants"), F.struct(F.col("genes").alias("target_coverage")).alias("qc")))
    value = F.when(s % 97 == 1, "{broken").when(s % 89 == 1, "{}").when(s % 2 == 0, earlier).otherwise(later)
    return files.select(s.cast("string").alias("file"), value.alias("value"))


def graded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = tools.load_graded(_graded_texts(spark, sf_dir))
    return rounded(rows.select("sample_id", "gene", "change", "vaf", "depth", "drug", "grade", "call", "tier"))


def graded_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tools.graded_coverage(_graded_texts(spark, sf_dir)))


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by status and reason: ok, failed (not readable), skipped (nothing in them)."""
    return tools.graded_status(_graded_texts(spark, sf_dir)).groupBy("status", "reason").agg(F.count("*").alias("n"))


def _coded(spark: SparkSession, sf_dir: str, codes: str) -> DataFrame:
    """One row per (sample, drug) with a code out of ``codes``, and what called it."""
    rows = _findings(spark, sf_dir).groupBy("sample", "drug").agg(F.max("k").alias("k"), F.array_sort(F.collect_set(F.concat_ws("_", "gene", "change"))).alias("names"))
    return rows.withColumn("code", F.substring(F.lit(codes), (F.col("k") % 5 + 1).cast("int"), 1))


def probe_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when((F.col("sample") % 53 == 1) & (F.col("k") > 4), "X").otherwise(F.col("code"))
    entry = F.struct(code.alias("predict"), F.map_from_arrays("names", F.transform("names", lambda _: F.lit("seen"))).alias("called_by"))
    made = _coded(spark, sf_dir, "RrSNU").groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct(F.initcap("drug").alias("k"), entry.alias("v")))).alias("m"))
    held = F.create_map(F.col("sample").cast("string"), F.struct(F.col("m").alias("susceptibility")))
    texts = made.select(F.col("sample").cast("string").alias("file"), F.to_json(held).alias("value"))
    rows, _ = tools.load_probes(texts)
    return rows.drop("file")


def antibiogram_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _coded(spark, sf_dir, "RSUFN").groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct(F.upper("drug").alias("k"), F.col("code").alias("v")))).alias("m"))
    s = F.col("sample")
    meta = F.struct(
        F.lit("gnomonicus").alias("workflow_name"), F.when(s % 11 == 3, "failed").otherwise("success").alias("status"), F.when(s % 13 == 5, "other").alias("sample_id"),
        F.lit("NC_000962.3").alias("reference"), F.lit("RUS").alias("catalogue_type"),
    )
    texts = made.select(s.cast("string").alias("file"), F.to_json(F.struct(meta.alias("meta"), F.struct(F.col("m").alias("antibiogram")).alias("data"))).alias("value"))
    named = made.select(s.cast("string").alias("file"), F.when(s % 17 != 2, F.concat(F.lit("s"), s.cast("string"))).alias("sample_id"))
    rows, failed = tools.load_antibiograms(texts, named)
    return rows.select("sample_id", "drug", "code", "call").unionByName(failed.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(None).alias("sample_id"), "reason", F.col("n").cast("string").alias("code"), F.lit(None).alias("call")).withColumnRenamed("reason", "drug"))


def species_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sample")
    drug = F.when(F.col("k") % 3 == 0, "macrolides").when(F.col("k") % 3 == 1, "amikacin").otherwise("linezolid")
    item = F.struct("gene", "change", F.lit("pass").alias("filter"), F.array(F.struct(drug.alias("drug"), F.lit("drug_resistance").alias("type"))).alias("drugs"))
    files = _findings(spark, sf_dir).groupBy("sample").agg(F.collect_list(item).alias("dr_variants"))
    one = F.array(F.struct(F.when(s % 5 == 0, "Mycobacterium avium").otherwise("Mycobacteroides abscessus").alias("species")))
    species = F.when(s % 7 == 0, F.array_repeat(one[0], 2)).otherwise(one)
    barcode = F.array(F.struct(F.lit("subsp. massiliense").alias("id"), F.when(s % 3 == 0, 1.0).otherwise(0.5).alias("frequency")))
    gene = F.array(F.struct(F.lit("erm(41)").alias("gene_name"), F.when(s % 2 == 0, "functionally_normal").otherwise("changed").alias("type"), F.lit("PASS").alias("filter")))
    value = F.to_json(F.struct(s.cast("string").alias("id"), "dr_variants", F.array().cast("array<string>").alias("other_variants"), gene.alias("dr_genes"), F.struct(species.alias("species")).alias("species"), barcode.alias("barcode")))
    rows, _ = tools.load_species_profiles(files.select(s.cast("string").alias("file"), value.alias("value")))
    return rows.drop("file")


def gene_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, left_out = tools.load_gene_hits(bound(spark, sf_dir, "hits"))
    return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(left_out, allowMissingColumns=True).select("hit", "gene", "drug", "call", "tier", "point", "reason")


def _collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of one cell per drug; drugs without a finding hold a dash."""
    cell = F.concat("gene", F.lit(" "), "change", F.lit(" ("), F.col("freq").cast("string"), F.lit(")"))
    cells = F.array_join(F.sort_array(F.collect_list(cell)), ", ")
    return _findings(spark, sf_dir).groupBy("sample").pivot("drug", list(COLLATE)).agg(cells).na.fill("-").withColumn("sample", F.col("sample").cast("string"))


def collate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tools.collate_long(_collated(spark, sf_dir), COLLATE))


def engine_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _collated(spark, sf_dir)
    return tools.detected(tools.collate_long(wide, COLLATE), wide, sorted(d for d in COLLATE.values() if d))


def engine_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tools.distinct_variants(tools.collate_long(_collated(spark, sf_dir), COLLATE)))


def strongest_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.strongest_call(bound(spark, sf_dir, "evidence"), ["isolate_id", "engine", "drug"])


def depth_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "depths").withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("mean_depth", "callable_fraction", "covered_bp", "total_bp")})
    return rounded(coverage_tables.from_depth(rows))


def region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "regions").withColumnRenamed("stop", "end")
    lengths = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("locus"), F.when(F.col("p_size") > 5, F.col("p_size") * 10).alias("length"))
    return rounded(coverage_tables.from_regions(rows, lengths, []))


def position_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = bound(spark, sf_dir, "blocks").select("chrom", F.col("start").alias("pos"), "depth")
    return rounded(coverage_tables.from_positions(blocks, bound(spark, sf_dir, "spans").withColumnRenamed("stop", "end"), ["chrom"]))


def threshold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = bound(spark, sf_dir, "spans").withColumnRenamed("stop", "end").withColumn("n_at_floor", F.col("locus") % 300)
    means = spans.where("locus % 4 > 0").select("chrom", "locus", (F.col("locus") % 37 / 2).alias("mean"))
    return rounded(coverage_tables.from_thresholds(spans, means, ["chrom"]))


def variant_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "changes")
    c: Column = F.trim("change")
    protein = variants.is_protein_change(F.col("change"))
    p, n = F.when(protein, c), F.when(~protein, c)
    place = [F.col(x) for x in ("pos", "ref", "alt")]
    return rows.select(
        "id", protein.alias("protein"), variants.variant_key(F.lit("asm"), F.col("gene"), F.col("chrom"), *place, n, p).alias("variant_key"),
        variants.variant_label(F.col("gene"), *place, n, p).alias("label"), variants.locus_of(variants.variant_label(F.col("gene"), *place, n, p)).alias("locus"),
    )


def variant_consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "changes").withColumn("place", variants.region_of(F.col("region"), F.col("change")))
    return rows.select("id", F.col("place").alias("region"), variants.consequence_of(F.col("effect"), F.col("change"), F.col("place")).alias("consequence"))


def cohort_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "sheet")
    return rounded(rows.select(
        "id", variants.cohort_tier(F.col("errors"), F.col("study")).alias("tier"), variants.confirms_country(F.col("place"), F.lit("UNITED")).alias("confirmed"),
        variants.percent(F.col("share")).alias("percent"), variants.site_of(F.col("dotted")).alias("site"), variants.grade_weight(F.col("grade")).alias("weight"),
    ))


def _baseline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    calls, determinants = bound(spark, sf_dir, "examined"), bound(spark, sf_dir, "graded").where("call = 'resistant' AND drug < '5'").select("drug", "label")
    found = baseline.predictions(bound(spark, sf_dir, "truths"), calls.where("carried = 1"), calls.where("assessed = 1"), determinants)
    return found, determinants


def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(spark, sf_dir)[0]


def catalogue_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline.measure(*_baseline(spark, sf_dir)))


def isolates_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.needed(baseline.measure(*_baseline(spark, sf_dir), min_answered=1_000_000))


def _rates(found: DataFrame) -> DataFrame:
    said = found.withColumn("call", F.when(F.col("predicted") == "R", "resistant").when(F.col("predicted") == "S", "susceptible"))
    return accuracy.with_rates(accuracy.confusion_by_lineage(said, "call", "truth"))


def baseline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, determinants = _baseline(spark, sf_dir)
    return rounded(baseline.report_rows(baseline.measure(found, determinants), _rates(found)))


def baseline_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = baseline.lineage_rows(_rates(_baseline(spark, sf_dir)[0]))
    return rounded(rates.select("drug", "lineage", "n_evaluable", "tp", "fp", "tn", "fn", "n_abstained", "vme_rate", "me_rate"))


def lineage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline.strata_matrix(_rates(_baseline(spark, sf_dir)[0]), ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "unknown"]))


def measurability(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = bound(spark, sf_dir, "drugs")
    catalogued = bound(spark, sf_dir, "graded").where("call = 'resistant'").select(F.upper("drug").alias("drug"))
    return baseline.measurability(wanted, catalogued, bound(spark, sf_dir, "truths").where("drug > '1'").select("drug"))


_OK = "sample % 97 <> 1 AND sample % 89 <> 1"
_CODED = ", cc AS (SELECT sample, drug, MAX(k) AS k, string_agg(DISTINCT gene || '_' || change, ', ' ORDER BY gene || '_' || change) AS names FROM findings GROUP BY sample, drug)"
_BASE = """, dt AS (SELECT drug, label FROM graded WHERE call = 'resistant' AND drug < '5'), lo AS (SELECT DISTINCT drug, split_part(label, '_', 1) AS locus FROM dt), nl AS (SELECT drug, COUNT(*) AS n FROM lo GROUP BY drug),
ca AS (SELECT DISTINCT isolate_id, drug FROM examined JOIN dt ON dt.label = examined.label WHERE carried = 1),
se AS (SELECT isolate_id, drug, COUNT(*) AS n FROM (SELECT DISTINCT isolate_id, split_part(label, '_', 1) AS locus FROM examined WHERE assessed = 1) AS s JOIN lo ON lo.locus = s.locus GROUP BY isolate_id, drug),
bp AS (SELECT t.*, CASE WHEN ca.drug IS NOT NULL THEN 'R' WHEN coalesce(se.n, 0) / CAST(nl.n AS DOUBLE) >= 0.95 THEN 'S' END AS predicted, nl.n AS loci FROM truths AS t LEFT JOIN nl ON nl.drug = t.drug
  LEFT JOIN ca ON ca.isolate_id = t.isolate_id AND ca.drug = t.drug LEFT JOIN se ON se.isolate_id = t.isolate_id AND se.drug = t.drug),
bq AS (SELECT isolate_id, drug, truth, lineage, predicted, CASE WHEN loci IS NULL THEN 'no determinants' WHEN predicted IS NULL THEN 'incomplete' END AS abstained FROM bp),
bm AS (SELECT q.drug AS drug, COUNT(*) AS n_isolates, COUNT(predicted) AS n_answered, COUNT(CASE WHEN predicted <> truth THEN 1 END) AS n_errors, COUNT(CASE WHEN truth = 'R' THEN 1 END) AS n_resistant_truth, COUNT(CASE WHEN truth = 'S' THEN 1 END) AS n_susceptible_truth,
  COUNT(CASE WHEN predicted = 'R' AND truth = 'S' THEN 1 END) AS called_r_truth_s, COUNT(CASE WHEN predicted = 'S' AND truth = 'R' THEN 1 END) AS called_s_truth_r, COUNT(CASE WHEN abstained = 'no determinants' THEN 1 END) AS no_determinants,
  COUNT(CASE WHEN abstained = 'incomplete' THEN 1 END) AS incomplete FROM bq AS q GROUP BY q.drug),
bs AS (SELECT bm.*, coalesce(n, 0) AS n_determinants FROM bm LEFT JOIN (SELECT drug, COUNT(DISTINCT label) AS n FROM dt GROUP BY drug) AS d ON d.drug = bm.drug),
bl AS (SELECT drug, coalesce(lineage, 'unknown') AS lineage, COUNT(*) AS n_evaluable, COUNT(CASE WHEN predicted = 'R' AND truth = 'R' THEN 1 END) AS tp, COUNT(CASE WHEN predicted = 'R' AND truth = 'S' THEN 1 END) AS fp, COUNT(CASE WHEN predicted = 'S' AND truth = 'S' THEN 1 END) AS tn,
  COUNT(CASE WHEN predicted = 'S' AND truth = 'R' THEN 1 END) AS fn, COUNT(CASE WHEN predicted IS NULL THEN 1 END) AS n_abstained FROM bq GROUP BY drug, coalesce(lineage, 'unknown')),
br AS (SELECT *, CAST(fn AS DOUBLE) / nullif(tp + fn, 0) AS vme, CAST(fp AS DOUBLE) / nullif(tn + fp, 0) AS me FROM bl)
"""
_BASED = "truths examined graded"

QUERIES = {f.__name__: f for f in (
    graded_results, graded_coverage, file_status, probe_predictions, antibiogram_results, species_profiles, gene_hits, collate_findings, engine_calls, engine_variants, strongest_calls,
    depth_coverage, region_coverage, position_coverage, threshold_coverage, variant_identities, variant_consequences, cohort_fields, baseline_predictions, catalogue_baseline, isolates_needed,
    baseline_report, baseline_lineages, lineage_matrix, measurability,
)}
SQL = {
    "graded_results": with_bindings("findings", f""" SELECT CAST(sample AS VARCHAR) AS sample_id, gene, change, round(freq, 6) + 0.0 AS vaf, depth, drug, grade,
  CASE grade WHEN 'Assoc w R' THEN 'resistant' WHEN 'Not assoc w R' THEN 'susceptible' ELSE 'indeterminate' END AS call, CASE WHEN grade IS NULL THEN 'none' ELSE 'catalogued' END AS tier FROM findings WHERE {_OK}"""),
    "graded_coverage": with_bindings("findings", f""", fr AS (SELECT *, freq * CASE WHEN sample % 3 = 0 THEN 1000 ELSE 1 END AS f FROM findings WHERE {_OK})
SELECT CAST(sample AS VARCHAR) AS sample_id, gene AS locus, depth AS mean_depth, round(CASE WHEN f > 1 THEN f / 100 ELSE f END, 6) + 0.0 AS callable_fraction FROM fr"""),
    "file_status": with_bindings("findings", """ SELECT CASE WHEN sample % 97 = 1 OR sample % 89 = 1 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN sample % 97 = 1 THEN 'not JSON' WHEN sample % 89 = 1 THEN 'no list of resistance variants' ELSE '' END AS reason,
  COUNT(DISTINCT sample) AS n FROM findings GROUP BY 1, 2"""),
    "probe_predictions": with_bindings("findings", _CODED + """, bd AS (SELECT DISTINCT sample FROM cc WHERE sample % 53 = 1 AND k > 4), cd AS (SELECT *, substr('RrSNU', CAST(k % 5 + 1 AS BIGINT), 1) AS code FROM cc WHERE sample NOT IN (SELECT sample FROM bd))
SELECT CAST(sample AS VARCHAR) AS sample_id, drug, code, CASE code WHEN 'S' THEN 'susceptible' WHEN 'N' THEN 'not_assessed' WHEN 'U' THEN 'indeterminate' ELSE 'resistant' END AS call, CASE WHEN code IN ('N', 'U') THEN 'none' ELSE 'catalogued' END AS tier,
  code = 'S' AS asserts_coverage, names AS called_by FROM cd"""),
    "antibiogram_results": with_bindings("findings", _CODED + """, er AS (SELECT *, substr('RSUFN', CAST(k % 5 + 1 AS BIGINT), 1) AS code, CASE WHEN sample % 11 = 3 THEN 'not a discrete prediction' WHEN sample % 17 = 2 THEN 'no sample binding' WHEN sample % 13 = 5 THEN 'sample binding conflicts' END AS e FROM cc)
SELECT 's' || CAST(sample AS VARCHAR) AS sample_id, drug, code, CASE code WHEN 'R' THEN 'resistant' WHEN 'S' THEN 'susceptible' WHEN 'U' THEN 'indeterminate' ELSE 'no_call' END AS call FROM er WHERE e IS NULL
UNION ALL SELECT NULL, e, CAST(COUNT(DISTINCT sample) AS VARCHAR), NULL FROM er WHERE e IS NOT NULL GROUP BY e"""),
    "species_profiles": with_bindings("findings", """ SELECT CAST(sample AS VARCHAR) AS sample_id, CASE WHEN sample % 3 = 0 THEN 'massiliense' END AS subspecies, CASE WHEN sample % 2 = 0 THEN 'functional' END AS erm41_status, gene, change,
  CASE k % 3 WHEN 0 THEN 'clarithromycin' ELSE 'amikacin' END AS drug, 'indeterminate' AS call, 'inferred' AS tier FROM findings WHERE k % 3 < 2 AND sample % 5 > 0 AND sample % 7 > 0"""),
    "gene_hits": with_bindings("hits", """, hr AS (SELECT *, CASE WHEN element_type <> 'AMR' THEN 'other element' WHEN gene = '' THEN 'no gene' WHEN trim(coalesce(subclass, '')) = '' AND class IS NULL THEN 'no class' END AS reason FROM hits)
SELECT hit, gene, CASE WHEN reason IS NULL THEN lower(coalesce(nullif(trim(subclass), ''), class)) END AS drug, CASE WHEN reason IS NULL THEN 'indeterminate' END AS call,
  CASE WHEN reason IS NULL THEN CASE WHEN coalesce(identity < 90, false) OR coalesce(coverage < 90, false) THEN 'none' ELSE 'catalogued' END END AS tier, CASE WHEN reason IS NULL THEN upper(element_subtype) = 'POINT' END AS point, reason FROM hr"""),
    "collate_findings": with_bindings("findings", " SELECT CAST(sample AS VARCHAR) AS sample, drug, drug NOT IN ('medium', 'large') AS compared, gene, change, round(freq, 6) + 0.0 AS freq FROM findings"),
    "engine_calls": with_bindings("findings", """ SELECT CAST(s.sample AS VARCHAR) AS sample, d.drug AS drug, CASE WHEN f.sample IS NULL THEN 'not_assessed' ELSE 'resistant' END AS call FROM (SELECT DISTINCT sample FROM findings) AS s
CROSS JOIN (VALUES ('standard'), ('economy'), ('promo'), ('small')) AS d(drug) LEFT JOIN (SELECT DISTINCT sample, drug FROM findings) AS f ON f.sample = s.sample AND f.drug = d.drug"""),
    "engine_variants": with_bindings("findings", " SELECT CAST(sample AS VARCHAR) AS sample, gene, change, round(MAX(freq), 6) + 0.0 AS freq, MAX(freq) < 0.9 AS minority FROM findings GROUP BY sample, gene, change"),
    "strongest_calls": with_bindings("evidence", """ SELECT isolate_id, engine, drug, CASE MIN(CASE call WHEN 'resistant' THEN 1 WHEN 'indeterminate' THEN 2 WHEN 'no_call' THEN 3 WHEN 'susceptible' THEN 4 END) WHEN 1 THEN 'resistant' WHEN 2 THEN 'indeterminate' WHEN 3 THEN 'no_call' ELSE 'susceptible' END AS call
FROM evidence GROUP BY isolate_id, engine, drug"""),
    "depth_coverage": with_bindings("depths", """ SELECT id, locus, mean_depth, CASE WHEN callable_fraction BETWEEN 0 AND 1 THEN round(callable_fraction, 6) + 0.0 WHEN callable_fraction IS NULL AND total_bp > 0 THEN round(least(1.0, covered_bp / CAST(total_bp AS DOUBLE)), 6) + 0.0 END AS callable_fraction,
  CASE WHEN callable_fraction NOT BETWEEN 0 AND 1 THEN 'fraction outside 0..1' END AS error FROM depths"""),
    "region_coverage": with_bindings("regions", """ SELECT locus, CAST(round_even(AVG(depth), 0) AS BIGINT) AS mean_depth, CASE WHEN max(p_size) > 5 THEN round(least(1.0, SUM(stop - start) / CAST(max(p_size) * 10 AS DOUBLE)), 6) + 0.0 END AS callable_fraction
FROM regions JOIN part ON p_partkey = locus GROUP BY locus"""),
    "position_coverage": with_bindings("blocks spans", """, ps AS (SELECT s.chrom AS chrom, s.locus AS locus, COUNT(CASE WHEN depth >= 10 THEN 1 END) AS ok, AVG(depth) AS d FROM spans AS s JOIN blocks AS b ON b.chrom = s.chrom AND b.start >= s.start AND b.start < s.stop GROUP BY s.chrom, s.locus)
SELECT s.chrom AS chrom, s.locus AS locus, CAST(round_even(d, 0) AS BIGINT) AS mean_depth, round(least(1.0, coalesce(ok, 0) / CAST(greatest(1, s.stop - s.start) AS DOUBLE)), 6) + 0.0 AS callable_fraction FROM spans AS s LEFT JOIN ps ON ps.chrom = s.chrom AND ps.locus = s.locus"""),
    "threshold_coverage": with_bindings("spans", """ SELECT chrom, locus, CASE WHEN locus % 4 > 0 THEN CAST(round_even(locus % 37 / CAST(2 AS DOUBLE), 0) AS BIGINT) END AS mean_depth, round(least(1.0, locus % 300 / CAST(greatest(1, stop - start) AS DOUBLE)), 6) + 0.0 AS callable_fraction FROM spans"""),
    "variant_identities": with_bindings("changes", """, nm AS (SELECT *, trim(change) AS c FROM changes),
np AS (SELECT *, CASE WHEN c LIKE 'c.%' OR c LIKE 'n.%' OR c LIKE 'g.%' OR c LIKE '-%' THEN false ELSE c LIKE 'p.%' OR regexp_matches(lower(c), 'stop|fs|del|ins|dup|[*]') OR regexp_matches(c, '^[A-Z].*[0-9]') END AS protein FROM nm),
nc AS (SELECT *, CASE WHEN c <> '' THEN c WHEN pos IS NOT NULL AND ref <> '' AND alt <> '' THEN ref || CAST(pos AS VARCHAR) || alt ELSE 'unknown' END AS named FROM np)
SELECT id, protein, CASE WHEN pos IS NOT NULL AND ref <> '' AND alt <> '' THEN 'asm:' || coalesce(nullif(chrom, ''), '.') || ':' || CAST(pos AS VARCHAR) || ':' || ref || '>' || alt ELSE 'unresolved:asm:' || gene || ':' || named END AS variant_key, gene || '_' || named AS label, gene AS locus FROM nc"""),
    "variant_consequences": with_bindings("changes", """, rg AS (SELECT id, trim(change) AS c, lower(trim(coalesce(effect, ''))) AS e, CASE WHEN lower(trim(region)) = 'promoter' THEN 'promoter' WHEN lower(trim(region)) = 'rrna' THEN 'rrna' WHEN lower(trim(region)) = 'intergenic' THEN 'intergenic'
  WHEN regexp_matches(trim(change), '^(c[.])?-') THEN 'promoter' ELSE 'coding' END AS region FROM changes),
pt AS (SELECT *, upper(regexp_extract(c, '^(?:p[.])?([A-Za-z][^0-9]*)[0-9]+([^0-9]*)$', 1)) AS h, upper(regexp_extract(c, '^(?:p[.])?([A-Za-z][^0-9]*)[0-9]+([^0-9]*)$', 2)) AS t FROM rg)
SELECT id, region, CASE WHEN e = 'missense_variant' THEN 'missense' WHEN e = 'synonymous' THEN 'synonymous' WHEN lower(c) LIKE '%fs%' THEN 'frameshift' WHEN lower(c) LIKE '%stop%' OR c LIKE '%*' THEN 'nonsense' WHEN regexp_matches(lower(c), 'del|ins|dup') THEN 'inframe_indel'
  WHEN region = 'rrna' THEN 'rrna' WHEN region IN ('promoter', 'intergenic') THEN 'upstream' WHEN h <> '' AND t = h THEN 'synonymous' WHEN h <> '' AND regexp_matches(t, '^[A-Z]+$') THEN 'missense' ELSE 'unknown' END AS consequence FROM pt"""),
    "cohort_fields": with_bindings("sheet", """ SELECT id, CASE WHEN trim(coalesce(errors, '')) <> '' THEN NULL WHEN trim(coalesce(study, '')) = '' OR lower(trim(study)) LIKE 'pending%' THEN 'B' ELSE 'A' END AS tier, coalesce(upper(place) LIKE 'UNITED%', false) AS confirmed,
  round(CASE WHEN share <= 1 THEN share * 100 ELSE share END, 6) + 0.0 AS percent, CASE WHEN id % 3 > 0 THEN CAST(id % 25 AS VARCHAR) END AS site, CASE WHEN grade <> 'other' THEN CAST(substr(grade, 1, 1) AS INTEGER) END AS weight FROM sheet"""),
    "baseline_predictions": with_bindings(_BASED, _BASE + "SELECT * FROM bq"),
    "catalogue_baseline": with_bindings(_BASED, _BASE + """SELECT drug, n_isolates, n_answered, n_errors, n_resistant_truth, n_susceptible_truth, called_r_truth_s, called_s_truth_r, no_determinants, incomplete, n_determinants, round(n_answered / CAST(n_isolates AS DOUBLE), 6) + 0.0 AS coverage,
  CASE WHEN n_answered >= 10 THEN round(n_errors / CAST(n_answered AS DOUBLE), 6) + 0.0 ELSE 0.0 END AS error_rate, n_answered >= 10 AS estimable FROM bs"""),
    "isolates_needed": with_bindings(_BASED, _BASE + """SELECT drug, n_isolates, n_answered >= 1000000 AS estimable, CASE WHEN n_answered < 1000000 AND n_resistant_truth > 0 AND n_answered > 0 THEN
  CAST(greatest(0, floor(10 / (CAST(n_resistant_truth AS DOUBLE) / n_isolates) / (CAST(n_answered AS DOUBLE) / n_isolates)) - n_isolates) AS BIGINT) END AS isolates_needed FROM bs"""),
    "baseline_report": with_bindings(_BASED, _BASE + """, po AS (SELECT drug, SUM(tp) AS tp, SUM(fp) AS fp, SUM(tn) AS tn, SUM(fn) AS fn FROM bl GROUP BY drug)
SELECT bs.drug AS drug, n_isolates, n_answered, n_determinants, n_answered >= 10 AS estimable, round(n_answered / CAST(n_isolates AS DOUBLE), 6) + 0.0 AS coverage, CASE WHEN n_answered >= 10 THEN round(n_errors / CAST(n_answered AS DOUBLE), 6) + 0.0 END AS error_rate,
  CASE WHEN n_answered >= 10 THEN round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) + 0.0 END AS sensitivity, CASE WHEN n_answered >= 10 THEN round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 6) + 0.0 END AS specificity,
  CASE WHEN n_answered >= 10 THEN round(CAST(fn AS DOUBLE) / nullif(tp + fn, 0), 6) + 0.0 END AS vme_rate, CASE WHEN n_answered >= 10 THEN round(CAST(fp AS DOUBLE) / nullif(tn + fp, 0), 6) + 0.0 END AS me_rate FROM bs JOIN po ON po.drug = bs.drug"""),
    "baseline_lineages": with_bindings(_BASED, _BASE + "SELECT drug, lineage, n_evaluable, tp, fp, tn, fn, n_abstained, round(vme, 6) + 0.0 AS vme_rate, round(me, 6) + 0.0 AS me_rate FROM br WHERE drug IN (SELECT drug FROM bl WHERE lineage <> 'unknown')"),
    "lineage_matrix": with_bindings(_BASED, _BASE + ", ce AS (SELECT drug, lineage, round((coalesce(vme, 0) + coalesce(me, 0)) / nullif(CAST(vme IS NOT NULL AS INTEGER) + CAST(me IS NOT NULL AS INTEGER), 0), 6) + 0.0 AS v FROM br) SELECT drug, "
        + ", ".join(f"MAX(CASE WHEN lineage = '{x}' THEN v END) AS \"{x}\"" for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "unknown")) + " FROM ce GROUP BY drug"),
    "measurability": with_bindings("drugs graded truths", """, mm AS (SELECT drug, drug IN (SELECT drug FROM graded WHERE call = 'resistant') AS c, drug IN (SELECT drug FROM truths WHERE drug > '1') AS p FROM drugs)
SELECT drug, c AS in_catalogue, p AS in_phenotype_source, c AND p AS measurable, CASE WHEN c AND p THEN '' WHEN c THEN 'phenotype' WHEN p THEN 'catalogue' ELSE 'both' END AS missing_side FROM mm"""),
}
