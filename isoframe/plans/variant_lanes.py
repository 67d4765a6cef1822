"""Queries of annotated variants, evidence lanes, targets and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions.measures import detection_probability, posterior
from isoframe.operators import censored, effects, lanes, selection, targets
from isoframe.plans.bindings import bound, rounded, with_bindings
from isoframe.sources import annotated
from isoframe.sources.scratch import stored

LIMITS = [("illumina", 0.03), ("nanopore", 0.06)]


def _annotated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated files: one record for each row, of a kind that the row says; some files have no header or two samples."""
    rows = bound(spark, sf_dir, "records")
    k, text = F.col("kind"), lambda c: F.col(c).cast("string")
    info = F.when(k == 1, F.concat(F.lit("SVTYPE=DEL;GENE="), "gene")).when(k == 2, "SVTYPE=DEL").otherwise(F.concat(F.lit("GENE="), F.col("gene"), F.lit(";AACHANGE="), F.col("change"), F.lit(";EFFECT=missense_variant")))
    alt = F.when(k == 4, "<DUP>").when(k == 5, "T,G").otherwise("T")
    fmt, values = F.when(k == 6, "GT:AD").otherwise("GT:AF:DP"), F.when(k == 6, F.concat(F.lit("0/1:"), text("ref_depth"), F.lit(","), text("alt_depth"))).when(k == 5, F.concat(F.lit("1/2:0.25,0.5:"), text("depth"))).otherwise(F.concat(F.lit("0/1:"), text("af"), F.lit(":"), text("depth")))
    line = F.when(k == 3, F.concat_ws("\t", "chrom", text("pos"), F.lit("."))).otherwise(F.concat_ws("\t", "chrom", text("pos"), F.lit("."), F.lit("A"), alt, F.lit("50"), "filter", info, fmt, values))
    files = rows.select("file").distinct()
    last = F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS"), F.when(F.col("file") % 19 == 4, "1\tS2").otherwise("1"))
    heads = files.select("file", F.explode(F.array(F.concat(F.lit("##sampleID=P"), text("file")), F.lit("##platform=illumina"), F.when(F.col("file") % 23 != 6, last).otherwise("##end"))).alias("value"))
    return stored(heads.unionByName(rows.select("file", line.alias("value"))).select(F.col("file").cast("string").alias("file"), "value"), "lines")  # as files are: written once, read for heads and records


def annotated_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = annotated.load(_annotated_lines(spark, sf_dir))
    return rounded(annotated.gated(found).select("sample_id", "platform", "gene", "chrom", "pos", "ref", "alt", "change", "region", "consequence", "vaf", "depth", "alt_depth", "drop_reason"))


def annotated_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = annotated.load(_annotated_lines(spark, sf_dir))
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


def table_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "changes").select("id", "gene", "change", "region", F.col("effect").alias("consequence"), F.when(F.col("id") % 3 > 0, F.col("id") % 100 / 100).alias("vaf"))
    return rounded(annotated.from_table(rows))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "variants")


def catalogue_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _variants(spark, sf_dir).select("sample_id", "variant_key", "label").distinct()
    return lanes.catalogue_matches(rows, bound(spark, sf_dir, "entries")).select("sample_id", "variant_key", "label", "drug", "call", "by_coordinates")


def _catalogued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.catalogue_evidence(_variants(spark, sf_dir), bound(spark, sf_dir, "entries"), "v1")


def catalogue_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogued(spark, sf_dir)


def regulator_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.regulator_evidence(_variants(spark, sf_dir), bound(spark, sf_dir, "regulators"), bound(spark, sf_dir, "promoters"))


def uncertain_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.uncertain_evidence(_variants(spark, sf_dir), bound(spark, sf_dir, "drug_loci"), lanes.resolved_labels(bound(spark, sf_dir, "entries")))


def lane_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = [f(spark, sf_dir) for f in (_catalogued, regulator_evidence, uncertain_evidence)]
    return lanes.lane_counts(lanes.dispatch(_variants(spark, sf_dir), spoken)[1])


def regulatory_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.regulatory_matches(_variants(spark, sf_dir), bound(spark, sf_dir, "areas"))


def blocked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lanes.blocked(bound(spark, sf_dir, "evidence"), bound(spark, sf_dir, "qc"), bound(spark, sf_dir, "profile"))
    return out.groupBy("isolate_id", "drug", "call", "tier").agg(F.count("*").alias("n"))


def drug_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    drugs = sorted(r.drug for r in bound(spark, sf_dir, "profile").select("drug").distinct().collect())
    seen = bound(spark, sf_dir, "truths").select("isolate_id", "drug")
    return lanes.universe(bound(spark, sf_dir, "isolates"), drugs, seen)


def unsupported_drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drugs that truths name and the profile does not."""
    return bound(spark, sf_dir, "truths").select("drug").exceptAll(bound(spark, sf_dir, "profile").select("drug")).distinct()


def merged_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _variants(spark, sf_dir).select("sample_id", "variant_key", "gene", "platform")
    a, b = v.where("platform = 'illumina'"), v.where("platform IS NULL OR platform <> 'illumina'")
    return annotated.union_first([a, b], ["sample_id", "variant_key"])


def _minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = _variants(spark, sf_dir)
    pairs = _catalogued(spark, sf_dir).where("call IN ('resistant', 'indeterminate')").select("sample_id", "variant_key", "drug")
    one = variants.groupBy("sample_id", "variant_key").agg(F.min(F.struct("vaf", "depth", "alt_depth", "platform")).alias("v")).select("sample_id", "variant_key", "v.*")
    return lanes.minority_findings(one, pairs, spark.createDataFrame(LIMITS, "platform string, lod double"))


def minority_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_minority(spark, sf_dir))


def minority_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posterior(detection_probability(F.col("vaf"), F.lit(0.05), F.lit(60.0)), F.when(F.col("drug") < "P", 0.3), F.lit(0.02), F.lit(20))
    return rounded(lanes.minority_evidence(_minority(spark, sf_dir).withColumn("posterior", p["probability"])))


def _barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    escapes = bound(spark, sf_dir, "escapes")
    n = bound(spark, sf_dir, "isolates").agg(F.count("*").alias("n_screened"))
    screened = bound(spark, sf_dir, "drug_loci").select("gene", "drug").distinct().join(F.broadcast(n)).withColumn("n_screened", F.when(F.col("gene") == "g3", 20).otherwise(F.col("n_screened")))
    return targets.barriers(escapes, screened, min_screened=100)


def barrier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets.ranked(_barriers(spark, sf_dir)))


def barrier_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets.contrast(_barriers(spark, sf_dir), "low", "g7", {"low": "g5"}))


def two_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mic = censored.log2_bounds(censored.parsed(bound(spark, sf_dir, "raw_mic")))
    return rounded(targets.two_modes(mic, ["drug"], max_censored=0.5), 4)


def _moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Shifts of tested labels against isolates that carry none of them."""
    carriage = bound(spark, sf_dir, "examined").where("carried = 1").select("isolate_id", "label")
    tested = carriage.where("label IN ('g7_v7', 'g8_v8', 'g9_v9')").select("label").distinct()
    reference = stored(targets.reference_group(bound(spark, sf_dir, "isolates").select("isolate_id"), carriage, tested), "reference")
    held = carriage.join(tested.hint("broadcast"), "label", "left_semi")
    mic = censored.log2_bounds(censored.parsed(bound(spark, sf_dir, "raw_mic"))).select("isolate_id", "drug", "log2_bound", "censoring")
    count = lambda df, *by: df.groupBy(*by, "drug", "log2_bound", "censoring").agg(F.count("*").alias("n"))
    a, b = count(mic.join(held.hint("merge"), "isolate_id"), "label"), count(mic.join(reference.hint("merge"), "isolate_id"))
    empty = [F.lit("").alias(c) for c in effects.STRATUM]
    everyone = tested.hint("broadcast").join(b)
    bins = a.select("label", "drug", *empty, "log2_bound", "censoring", F.col("n").alias("n_a"), F.lit(0).cast("long").alias("n_b"))
    bins = bins.unionByName(everyone.select("label", "drug", *empty, "log2_bound", "censoring", F.lit(0).cast("long").alias("n_a"), F.col("n").alias("n_b")))
    return effects.stratum_shifts(bins), reference.count()


def mechanism_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.mechanisms(_moved(spark, sf_dir)[0], ["1-URGENT", "2-HIGH"], 0.05)


def discriminator_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifts, n = _moved(spark, sf_dir)
    return rounded(targets.discrimination(targets.mechanisms(shifts, ["1-URGENT", "2-HIGH"], 0.05), ["g7", "g8"], "g9", n))


def capped_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "cohort").select("sample_id", "project", "organism", "bases")
    return selection.shortlist(rows, {"project": 40, "organism": 60}, 90, stored)


def project_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "cohort").select("sample_id", "project", "bases")
    return selection.shortlist(rows, {"project": 25}, None, stored)


def independent_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.independent(bound(spark, sf_dir, "metadata"), stored).select("isolate_id", "reason")


def partition_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.crossing_groups(bound(spark, sf_dir, "metadata"))


def top_cooccurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    carriage = bound(spark, sf_dir, "examined").where("carried = 1").select("isolate_id", "label")
    pairs = carriage.join(carriage.withColumnRenamed("label", "other"), "isolate_id").where("label <> other").groupBy("label", "other").agg(F.count("*").alias("n"))
    return selection.top_per_key(pairs, ["label"], [F.col("n").desc(), "other"], 5)


def eligible_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_eligible(bound(spark, sf_dir, "wide").select("sample_id", "run"), "run <> 'NONE'", "sample_id", 50)


_VARIANTS = "variants entries"
_MATCH = """, ky AS (SELECT DISTINCT variant_key, drug, call FROM entries WHERE variant_key IS NOT NULL), mt AS (SELECT v.*, ky.drug AS drug, ky.call AS call, true AS by_coordinates FROM variants AS v JOIN ky ON ky.variant_key = v.variant_key
  UNION ALL SELECT v.*, e.drug, e.call, false FROM variants AS v JOIN (SELECT DISTINCT label, drug, call FROM entries) AS e ON e.label = v.label WHERE v.variant_key NOT IN (SELECT variant_key FROM ky)),
ce AS (SELECT DISTINCT sample_id, variant_key, label, gene, drug, CASE call WHEN 'not_associated' THEN 'susceptible' ELSE call END AS call, 'catalogued' AS tier, 'catalogue' AS lane, CASE WHEN NOT by_coordinates THEN 'matched by label' END AS limitation,
  'v1:' || label || ':' || drug || ':' || CASE call WHEN 'not_associated' THEN 'susceptible' ELSE call END AS rule_id FROM mt)"""
_REGULATORS = """, hd AS (SELECT * FROM variants WHERE consequence <> 'synonymous'),
ru AS (SELECT h.*, r.drug AS drug, CASE WHEN consequence = 'frameshift' THEN 'loss of function not graded' ELSE 'weaker than loss of function' END AS limitation, 0 AS k FROM hd AS h JOIN (SELECT DISTINCT gene, drug FROM regulators) AS r ON r.gene = h.gene
  UNION ALL SELECT h.*, p.drug, 'expression not measured', 1 FROM hd AS h JOIN (SELECT DISTINCT gene, drug FROM promoters) AS p ON p.gene = h.gene WHERE region = 'promoter'),
re AS (SELECT sample_id, variant_key, label, gene, drug, 'indeterminate' AS call, 'inferred' AS tier, 'regulatory' AS lane, limitation, CAST(NULL AS VARCHAR) AS rule_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, variant_key, drug ORDER BY k, label, limitation) AS n FROM ru) WHERE n = 1)"""
_OPEN = """, ue AS (SELECT DISTINCT sample_id, variant_key, label, v.gene AS gene, l.drug AS drug, 'indeterminate' AS call, 'none' AS tier, 'uncertain' AS lane, 'no graded entry' AS limitation, CAST(NULL AS VARCHAR) AS rule_id FROM variants AS v JOIN (SELECT DISTINCT gene, drug FROM drug_loci) AS l ON l.gene = v.gene
  WHERE consequence <> 'synonymous' AND label NOT IN (SELECT label FROM entries GROUP BY label HAVING bool_and(call IN ('resistant', 'susceptible', 'not_associated'))))"""
_MINOR = _MATCH + """, vo AS (SELECT sample_id, variant_key, vaf, depth, alt_depth, platform FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, variant_key ORDER BY vaf NULLS FIRST, depth NULLS FIRST, alt_depth NULLS FIRST, platform NULLS FIRST) AS n FROM variants) WHERE n = 1),
mf AS (SELECT DISTINCT c.sample_id AS sample_id, c.variant_key AS variant_key, drug, vaf, depth, platform, CASE platform WHEN 'illumina' THEN CAST(0.03 AS DOUBLE) WHEN 'nanopore' THEN CAST(0.06 AS DOUBLE) END AS lod, coalesce(alt_depth, CAST(round_even(vaf * depth, 0) AS BIGINT)) AS alt
  FROM ce AS c JOIN vo ON vo.sample_id = c.sample_id AND vo.variant_key = c.variant_key WHERE call IN ('resistant', 'indeterminate')),
ms AS (SELECT *, CASE WHEN vaf IS NULL THEN 'no fraction' WHEN platform IS NULL THEN 'no platform' WHEN lod IS NULL THEN 'no limit' WHEN depth IS NULL OR depth < 10 THEN 'depth' WHEN alt < 5 THEN 'few reads' WHEN vaf >= 0.9 THEN 'majority' WHEN vaf < lod THEN 'below limit' ELSE 'minority' END AS reason FROM mf)"""
_BARRIER = """, rt AS (SELECT gene, drug, variant, COUNT(DISTINCT isolate_id) AS n, MAX(CASE WHEN consequence = 'frameshift' THEN 1 ELSE 0 END) AS cut FROM escapes GROUP BY gene, drug, variant),
rs AS (SELECT gene, drug, COUNT(*) AS n_routes, CAST(SUM(n) AS BIGINT) AS n_escape, CAST(SUM(n * cut) AS BIGINT) AS lost FROM rt GROUP BY gene, drug),
lv AS (SELECT gene, drug, lineage, COUNT(DISTINCT variant) AS v FROM escapes WHERE lineage IS NOT NULL GROUP BY gene, drug, lineage), lb AS (SELECT gene, drug, CAST(SUM(v) AS DOUBLE) * SUM(v) / SUM(v * v) AS breadth FROM lv GROUP BY gene, drug),
sn AS (SELECT DISTINCT gene, drug, CASE WHEN gene = 'g3' THEN 20 ELSE (SELECT COUNT(*) FROM isolates) END AS n_screened FROM drug_loci),
bb AS (SELECT sn.gene AS gene, sn.drug AS drug, n_screened, coalesce(n_routes, 0) AS n_routes, coalesce(n_escape, 0) AS n, coalesce(lost, 0) AS lost, coalesce(breadth, 0) AS breadth FROM sn LEFT JOIN rs ON rs.gene = sn.gene AND rs.drug = sn.drug LEFT JOIN lb ON lb.gene = sn.gene AND lb.drug = sn.drug),
bc AS (SELECT *, CASE WHEN n_screened >= 100 AND n >= 5 THEN (1 - least(1.0, n_routes / CAST(20 AS DOUBLE)) + 1 - least(1.0, greatest(0.0, (breadth - 1) / 3)) + 1 - lost / CAST(n AS DOUBLE) + 1 - least(1.0, n / CAST(n_screened AS DOUBLE) / CAST(0.1 AS DOUBLE))) / 4 END AS score FROM bb),
bd AS (SELECT *, CASE WHEN n_screened < 100 THEN 'not-estimated' WHEN n < 5 THEN 'no-observed-escape' WHEN score >= 0.66 THEN 'high' WHEN score >= 0.4 THEN 'moderate' ELSE 'low' END AS band FROM bc)"""
_MOVED = """, tl AS (SELECT isolate_id, label FROM examined WHERE carried = 1 AND label IN ('g7_v7', 'g8_v8', 'g9_v9')), rf AS (SELECT isolate_id FROM isolates WHERE isolate_id NOT IN (SELECT isolate_id FROM tl)),
mg AS (SELECT isolate_id, drug, CASE WHEN trim(mic) LIKE '<%' THEN 'left' WHEN trim(mic) LIKE '>%' THEN 'right' ELSE 'none' END AS s, log2(TRY_CAST(regexp_replace(trim(mic), '^[<>]=?\\s*', '') AS DOUBLE)) AS b FROM raw_mic WHERE trim(mic) <> 'NA'),
xa AS (SELECT label, drug, s, b, COUNT(*) AS n FROM mg JOIN tl ON tl.isolate_id = mg.isolate_id GROUP BY label, drug, s, b), xb AS (SELECT drug, s, b, COUNT(*) AS n FROM mg JOIN rf ON rf.isolate_id = mg.isolate_id GROUP BY drug, s, b),
xp AS (SELECT label, xa.drug AS drug, xa.n * xb.n AS w, CASE WHEN xa.s = 'none' AND xb.s = 'none' THEN sign(xa.b - xb.b)
    WHEN xa.s = 'left' AND xb.s = 'right' AND xa.b <= xb.b OR xa.s = 'left' AND xb.s = 'none' AND xa.b < xb.b OR xa.s = 'none' AND xb.s = 'right' AND xa.b <= xb.b THEN -1
    WHEN xa.s = 'right' AND xb.s = 'left' AND xb.b <= xa.b OR xa.s = 'none' AND xb.s = 'left' AND xb.b < xa.b OR xa.s = 'right' AND xb.s = 'none' AND xb.b <= xa.b THEN 1 END AS o FROM xa JOIN xb ON xa.drug = xb.drug),
xs AS (SELECT label, drug, SUM(w) AS pairs, SUM(CASE WHEN o IS NOT NULL THEN w ELSE 0 END) AS decisive, SUM(o * w) AS net FROM xp GROUP BY label, drug),
xn AS (SELECT label, drug, SUM(n) AS n_a FROM xa GROUP BY label, drug), xm AS (SELECT drug, SUM(n) AS n_b FROM xb GROUP BY drug),
xd AS (SELECT xs.label AS label, xs.drug AS drug, CASE WHEN n_a >= 5 AND n_b >= 5 AND decisive > 0 AND decisive >= 0.3 * pairs THEN CAST(net AS DOUBLE) / decisive END AS delta FROM xs JOIN xn ON xn.label = xs.label AND xn.drug = xs.drug JOIN xm ON xm.drug = xs.drug),
mo AS (SELECT label, COUNT(*) AS n_estimable, MIN(abs(delta)) AS least, bool_and(delta > 0) OR bool_and(delta < 0) AS concordant, COUNT(CASE WHEN abs(delta) >= 0.05 THEN 1 END) AS n_moved, coalesce(string_agg(CASE WHEN abs(delta) >= 0.05 THEN drug END, ',' ORDER BY drug), '') AS moved
  FROM xd WHERE delta IS NOT NULL AND drug IN ('1-URGENT', '2-HIGH') GROUP BY label),
mc AS (SELECT l.label AS label, coalesce(n_estimable, 0) AS n_estimable, coalesce(n_moved, 0) AS n_moved, coalesce(moved, '') AS moved,
  CASE WHEN coalesce(n_estimable, 0) < 2 THEN 'indeterminate' WHEN concordant AND least >= 0.05 THEN 'efflux-like' WHEN n_moved = 1 THEN 'target-like' ELSE 'indeterminate' END AS mechanism FROM (SELECT DISTINCT label FROM tl) AS l LEFT JOIN mo ON mo.label = l.label)"""

QUERIES = {f.__name__: f for f in (
    annotated_variants, annotated_rejects, table_variants, catalogue_matches, catalogue_evidence, regulator_evidence, uncertain_evidence, lane_counts, regulatory_matches, blocked_evidence, drug_universe,
    unsupported_drugs, merged_variants, minority_findings, minority_evidence, barrier_scores, barrier_contrast, two_modes, mechanism_calls, discriminator_check, capped_shortlist, project_shortlist,
    independent_isolates, partition_leaks, top_cooccurring, eligible_prefix,
)}
#: The mixture is fitted step by step, and selections under several caps depend on what was taken before, so they have no SQL; tests compare them with plain loops.
SQL = {
    "annotated_variants": with_bindings("records", """, al AS (SELECT *, 'T' AS alt, 0 AS a FROM records WHERE kind IN (0, 1, 5, 6) UNION ALL SELECT *, 'G', 1 FROM records WHERE kind = 5)
SELECT 'P' || CAST(file AS VARCHAR) AS sample_id, 'illumina' AS platform, gene, chrom, pos, CASE WHEN kind <> 1 THEN 'A' END AS ref, CASE WHEN kind <> 1 THEN alt END AS alt, CASE WHEN kind = 1 THEN 'del_disruption' ELSE change END AS change, 'coding' AS region,
  CASE WHEN kind = 1 THEN 'deletion' ELSE 'missense' END AS consequence, CASE kind WHEN 0 THEN round(af, 6) + 0.0 WHEN 5 THEN CASE a WHEN 0 THEN 0.25 ELSE 0.5 END WHEN 6 THEN CASE WHEN ref_depth + alt_depth > 0 THEN round(alt_depth / CAST(ref_depth + alt_depth AS DOUBLE), 6) + 0.0 END END AS vaf,
  CASE WHEN kind = 6 THEN ref_depth + alt_depth ELSE depth END AS depth, CASE WHEN kind = 6 THEN alt_depth END AS alt_depth, CASE WHEN filter <> 'PASS' THEN 'filter' WHEN CASE WHEN kind = 6 THEN ref_depth + alt_depth ELSE depth END < 10 THEN 'depth' END AS drop_reason
FROM al WHERE file % 19 <> 4 AND file % 23 <> 6"""),
    "annotated_rejects": with_bindings("records", """ SELECT CASE kind WHEN 2 THEN 'structural without gene' WHEN 3 THEN 'fewer than 8 columns' ELSE 'symbolic allele' END AS reason, COUNT(*) AS n FROM records WHERE kind IN (2, 3, 4) AND file % 19 <> 4 AND file % 23 <> 6 GROUP BY 1
UNION ALL SELECT CASE WHEN file % 23 = 6 THEN 'no header' ELSE 'several samples' END, COUNT(DISTINCT file) FROM records WHERE file % 19 = 4 OR file % 23 = 6 GROUP BY 1"""),
    "table_variants": with_bindings("changes", """, rg AS (SELECT id, gene, trim(change) AS c, lower(trim(coalesce(effect, ''))) AS e, CASE WHEN lower(trim(region)) = 'promoter' THEN 'promoter' WHEN lower(trim(region)) = 'rrna' THEN 'rrna' WHEN lower(trim(region)) = 'intergenic' THEN 'intergenic'
  WHEN regexp_matches(trim(change), '^(c[.])?-') THEN 'promoter' ELSE 'coding' END AS region FROM changes WHERE trim(change) <> ''),
pt AS (SELECT *, upper(regexp_extract(c, '^(?:p[.])?([A-Za-z][^0-9]*)[0-9]+([^0-9]*)$', 1)) AS h, upper(regexp_extract(c, '^(?:p[.])?([A-Za-z][^0-9]*)[0-9]+([^0-9]*)$', 2)) AS t FROM rg)
SELECT id, gene, c AS change, CASE WHEN id % 3 > 0 THEN round(id % 100 / CAST(100 AS DOUBLE), 6) + 0.0 END AS vaf, CAST(NULL AS BIGINT) AS depth, region, CASE WHEN e = 'missense_variant' THEN 'missense' WHEN e = 'synonymous' THEN 'synonymous' WHEN lower(c) LIKE '%fs%' THEN 'frameshift' WHEN c LIKE '%*' THEN 'nonsense'
  WHEN regexp_matches(lower(c), 'del|ins|dup') THEN 'inframe_indel' WHEN region = 'rrna' THEN 'rrna' WHEN region IN ('promoter', 'intergenic') THEN 'upstream' WHEN h <> '' AND t = h THEN 'synonymous' WHEN h <> '' AND regexp_matches(t, '^[A-Z]+$') THEN 'missense' ELSE 'unknown' END AS consequence, CAST(NULL AS VARCHAR) AS platform FROM pt"""),
    "catalogue_matches": with_bindings(_VARIANTS, _MATCH + " SELECT DISTINCT sample_id, variant_key, label, drug, call, by_coordinates FROM mt"),
    "catalogue_evidence": with_bindings(_VARIANTS, _MATCH + " SELECT * FROM ce"),
    "regulator_evidence": with_bindings("variants regulators promoters", _REGULATORS + " SELECT * FROM re"),
    "uncertain_evidence": with_bindings("variants entries drug_loci", _OPEN + " SELECT * FROM ue"),
    "lane_counts": with_bindings("variants entries regulators promoters drug_loci", _MATCH + _REGULATORS + _OPEN + """, ln AS (SELECT sample_id, variant_key, lane FROM ce UNION SELECT sample_id, variant_key, lane FROM re UNION SELECT sample_id, variant_key, lane FROM ue),
un AS (SELECT DISTINCT v.sample_id, v.variant_key, 'unexamined' AS lane FROM variants AS v LEFT JOIN ln ON ln.sample_id = v.sample_id AND ln.variant_key = v.variant_key WHERE ln.lane IS NULL)
SELECT sample_id, lane, COUNT(*) AS n FROM (SELECT * FROM ln UNION ALL SELECT * FROM un) GROUP BY sample_id, lane"""),
    "regulatory_matches": with_bindings("variants areas", """ SELECT DISTINCT sample_id, variant_key, area, 'label' AS matched_by FROM variants AS v JOIN areas AS a ON a.label = v.label
UNION SELECT sample_id, variant_key, area, 'place' FROM variants AS v JOIN areas AS a ON a.label IS NULL AND a.chrom = v.chrom AND v.pos BETWEEN a.start AND a.stop
UNION SELECT sample_id, variant_key, area, 'gene' FROM variants AS v JOIN areas AS a ON a.label IS NULL AND a.start IS NULL AND a.gene = v.gene WHERE region = 'promoter'"""),
    "blocked_evidence": with_bindings("evidence qc profile", """, fl AS (SELECT DISTINCT isolate_id FROM qc WHERE status = 'fail'),
bk AS (SELECT e.isolate_id AS isolate_id, drug, CASE WHEN f.isolate_id IS NOT NULL AND tier <> 'phenotypic' THEN 'indeterminate' ELSE call END AS call, tier FROM evidence AS e LEFT JOIN fl AS f ON f.isolate_id = e.isolate_id
  UNION ALL SELECT isolate_id, drug, 'no_call', 'none' FROM fl CROSS JOIN (SELECT DISTINCT drug FROM profile)) SELECT isolate_id, drug, call, tier, COUNT(*) AS n FROM bk GROUP BY isolate_id, drug, call, tier"""),
    "drug_universe": with_bindings("isolates profile truths", " SELECT isolate_id, drug FROM isolates CROSS JOIN (SELECT DISTINCT drug FROM profile) UNION SELECT isolate_id, drug FROM truths"),
    "unsupported_drugs": with_bindings("profile truths", " SELECT drug FROM truths EXCEPT SELECT drug FROM profile"),
    "merged_variants": with_bindings("variants", " SELECT sample_id, variant_key, gene, platform FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, variant_key ORDER BY CASE WHEN platform = 'illumina' THEN 0 ELSE 1 END, gene, platform NULLS FIRST) AS n FROM variants) WHERE n = 1"),
    "minority_findings": with_bindings(_VARIANTS, _MINOR + " SELECT sample_id, variant_key, drug, round(vaf, 6) + 0.0 AS vaf, depth, platform, lod, reason IN ('majority', 'below limit', 'minority') AS assessable, reason = 'minority' AS detected, reason FROM ms"),
    "minority_evidence": with_bindings(_VARIANTS, _MINOR + """, mp AS (SELECT *, 1 / (1 + exp(-60.0 * (vaf - 0.05))) AS s FROM ms WHERE reason = 'minority' AND drug < 'P')
SELECT DISTINCT sample_id, variant_key, drug, 'indeterminate' AS call, 'predicted' AS tier, round(s * 0.3 / (s * 0.3 + 0.02 * 0.7), 4) + 0.0 AS confidence FROM mp"""),
    "barrier_scores": with_bindings("escapes drug_loci isolates", _BARRIER + """ SELECT gene, drug, n_screened, n_routes, n AS n_escape_isolates, round(n / CAST(n_screened AS DOUBLE), 6) + 0.0 AS frequency, CASE WHEN n > 0 THEN round(lost / CAST(n AS DOUBLE), 6) + 0.0 END AS truncating_fraction,
  round(breadth, 6) + 0.0 AS lineage_breadth, round(score, 6) + 0.0 AS score, band FROM bd"""),
    "barrier_contrast": with_bindings("escapes drug_loci isolates", _BARRIER + """, ct AS (SELECT drug, MAX(CASE WHEN gene = 'g5' THEN band END) AS low_band, MAX(CASE WHEN gene = 'g7' THEN band END) AS high_band, MAX(CASE WHEN gene = 'g5' THEN score END) AS l, MAX(CASE WHEN gene = 'g7' THEN score END) AS h FROM bd GROUP BY drug)
SELECT drug, low_band, high_band, round(l, 6) + 0.0 AS low_score, round(h, 6) + 0.0 AS high_score, CASE WHEN low_band IS NULL OR high_band IS NULL THEN 'not-run' WHEN l IS NULL OR h IS NULL THEN 'underpowered' WHEN l < h THEN 'reproduces-known-contrast' ELSE 'fails-known-contrast' END AS verdict FROM ct"""),
    "mechanism_calls": with_bindings("examined isolates raw_mic", _MOVED + " SELECT * FROM mc"),
    "discriminator_check": with_bindings("examined isolates raw_mic", _MOVED + """, ds AS (SELECT COUNT(CASE WHEN label LIKE 'g7%' OR label LIKE 'g8%' THEN 1 END) AS e, COUNT(CASE WHEN (label LIKE 'g7%' OR label LIKE 'g8%') AND mechanism = 'efflux-like' THEN 1 END) AS er, COUNT(CASE WHEN label LIKE 'g9%' THEN 1 END) AS t,
  COUNT(CASE WHEN label LIKE 'g9%' AND mechanism = 'target-like' THEN 1 END) AS tr, (SELECT COUNT(*) FROM rf) AS n_reference FROM mc)
SELECT round(CAST(er AS DOUBLE) / nullif(e, 0), 6) + 0.0 AS efflux_right, round(CAST(tr AS DOUBLE) / nullif(t, 0), 6) + 0.0 AS target_right, n_reference, CASE WHEN n_reference < 5 OR e = 0 OR t = 0 THEN 'not-run' WHEN er >= 0.6 * e AND tr >= 0.6 * t THEN 'discriminates' ELSE 'does-not-discriminate' END AS verdict FROM ds"""),
    "project_shortlist": with_bindings("cohort", " SELECT sample_id, project, bases, CASE WHEN row_number() OVER (PARTITION BY project ORDER BY bases DESC, sample_id) > 25 THEN 'project' END AS reason FROM cohort"),
    "partition_leaks": with_bindings("metadata", """, gr AS (SELECT 'cluster' AS kind, CAST(cluster_id AS VARCHAR) AS "group", partition FROM metadata UNION ALL SELECT 'patient', CAST(site_id AS VARCHAR) || '|' || CAST(patient_id AS VARCHAR), partition FROM metadata)
SELECT kind, "group", COUNT(DISTINCT partition) AS n_partitions FROM gr GROUP BY kind, "group" HAVING COUNT(DISTINCT partition) > 1"""),
    "top_cooccurring": with_bindings("examined", """, cr AS (SELECT isolate_id, label FROM examined WHERE carried = 1), pq AS (SELECT a.label AS label, b.label AS other, COUNT(*) AS n FROM cr AS a JOIN cr AS b ON a.isolate_id = b.isolate_id WHERE a.label <> b.label GROUP BY a.label, b.label)
SELECT label, other, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, other) AS k FROM pq) WHERE k <= 5"""),
    "eligible_prefix": with_bindings("wide", " SELECT sample_id, run FROM wide WHERE run <> 'NONE' ORDER BY sample_id LIMIT 50"),
}
SQL["independent_isolates"] = with_bindings("metadata", """, ro AS (SELECT isolate_id, CAST(cluster_id AS VARCHAR) AS c, CAST(site_id AS VARCHAR) || '|' || CAST(patient_id AS VARCHAR) AS p, row_number() OVER (ORDER BY isolate_id) AS k FROM metadata),
fo AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS isolate_id, CAST([] AS VARCHAR[]) AS cs, CAST([] AS VARCHAR[]) AS ps, CAST(NULL AS VARCHAR) AS reason
  UNION ALL SELECT ro.k, ro.isolate_id, CASE WHEN list_contains(cs, c) OR list_contains(ps, p) THEN cs ELSE list_append(cs, c) END, CASE WHEN list_contains(cs, c) OR list_contains(ps, p) THEN ps ELSE list_append(ps, p) END,
    CASE WHEN list_contains(cs, c) THEN 'cluster_id' WHEN list_contains(ps, p) THEN 'patient' END FROM fo JOIN ro ON ro.k = fo.k + 1)
SELECT isolate_id, reason FROM fo WHERE k > 0""").replace("WITH ", "WITH RECURSIVE ", 1)
