"""Queries of the organism rule, the mechanism queue, sample pages and rows for readers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions.display import ACRONYMS, readable
from isoframe.operators import evidence, lanes, mechanisms, reports, shown
from isoframe.plans import report_views, variant_lanes
from isoframe.plans.bindings import BINDINGS, bound, rounded, with_bindings

#: A rule for each of two organisms of the given tables; the first drug has one under both.
RULES = {("mabscessus", "PROMO"): {"subspecies": None, "erm41_status": "nonfunctional", "rrl_status": "wild_type"}, ("mtbc", "PROMO"): {"rrl_status": "wild_type"}, ("mabscessus", "LARGE"): {"subspecies": "massiliense"}}
_AREA_TYPES = ["promoter_region", "intergenic", "smallRNA"]


def _joined(items: str, *fields: str) -> Column:
    """An array of structs as one text."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws("|", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields])), ";")


def organism_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = bound(spark, sf_dir, "isolates").select("isolate_id", F.explode(F.array(F.lit("PROMO"), F.lit("LARGE"), F.lit("SMALL"))).alias("drug"))
    return evidence.organism_refusals(pairs, bound(spark, sf_dir, "states"), RULES)


def organism_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isoframe.plans.queries import required_loci_gate, scope_permits

    gate, some = required_loci_gate(spark, sf_dir), bound(spark, sf_dir, "evidence").where("call <> 'resistant' OR engine = 'e1'")
    return evidence.reconcile(some, gate, scope_permits(spark, sf_dir), refused=evidence.organism_refusals(gate, bound(spark, sf_dir, "states"), RULES))


def _mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mechanisms.mechanism_queue(*[bound(spark, sf_dir, t) for t in ("variants", "regulators", "promoters")])


def mechanism_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mechanisms(spark, sf_dir).withColumns({"gaps": F.array_join("gaps", "; "), "experiments": F.array_join("experiments", "; ")})


def mechanism_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mechanisms.mechanism_cards(_mechanisms(spark, sf_dir)).withColumn("tags", F.array_join("tags", ";"))


def sample_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = bound(spark, sf_dir, "results").withColumn("sample_id", F.floor(F.col("sample_id") / 10))
    # A page shows the smallest row of a variant, so each match hands on its smallest drug.
    found = lanes.catalogue_evidence(bound(spark, sf_dir, "variants"), bound(spark, sf_dir, "entries"), "v1", [readable(F.col("drug")), readable(F.col("call"))])
    contexts = bound(spark, sf_dir, "isolates").join(bound(spark, sf_dir, "contexts"), "isolate_id").withColumnRenamed("isolate_id", "sample_id")
    out = reports.sample_pages(results, bound(spark, sf_dir, "coverage").withColumnRenamed("isolate_id", "sample_id"), found, contexts)
    loci = F.transform("loci", lambda x: F.struct(x["locus"].alias("locus"), (x["mean_depth"]).cast("long").alias("depth"), F.round(x["callable_fraction"] * 100).cast("long").alias("percent")))
    return out.withColumn("loci", loci).select(
        "sample_id", F.col("page").cast("long").alias("page"), "site", "lineage", "organism", "assay", _joined("calls", "drug", "call", "tier").alias("calls"), _joined("variants", "gene", "variant", "drug", "call", "tier").alias("variants"), _joined("loci", "locus", "depth", "percent").alias("loci"),
    )


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown.model_rows(bound(spark, sf_dir, "supplied_models")).select("model", "version", "cohort", "drug", "lineage", "call_rate", "error_rate", "sensitivity", "n_called", "n_dropped", "verdict", "verdict_key", "registry_ready", "notes")


def watch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown.watch_rows(report_views.watch_list(spark, sf_dir))


def ticket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown.ticket_rows(report_views.discordance_tickets(spark, sf_dir))


def target_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown.target_rows(bound(spark, sf_dir, "supplied_targets"))


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown.audit_rows(bound(spark, sf_dir, "audit"))


def epistasis_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown.epistasis_classes(*report_views.co_observed_classes(spark, sf_dir))


def population_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = report_views.frequency_groups(spark, sf_dir)
    named = groups.withColumn("lineage", F.when(F.col("sample_id") % 2 == 0, F.concat(F.lit("L"), F.col("size").cast("string"))))
    out = shown.population_rows(named, report_views.population_classes(spark, sf_dir))
    return out.withColumn("groups", F.array_join(F.transform("groups", lambda g: F.concat_ws("|", F.round(g["fraction"] * 100_000).cast("long").cast("string"), g["size"].cast("string"), g["lineage"])), ";"))


def concentration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isoframe.plans.queries import concentration_calls

    return shown.concentration_rows(concentration_calls(spark, sf_dir))


def structural_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown.structural_rows(bound(spark, sf_dir, "structures"))


def regulatory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = bound(spark, sf_dir, "areas").where("area % 7 > 0").withColumn("type", F.get(F.lit(_AREA_TYPES), (F.col("area") % 4).cast("int")))
    return shown.regulatory_classes(lanes.regulatory_classes(bound(spark, sf_dir, "variants"), bound(spark, sf_dir, "areas")), areas)


def expression_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown.expression_rows(report_views.expression_links(spark, sf_dir))


def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "variants").groupBy(F.col("label").alias("variant_key")).agg(F.min("pos").alias("p"))
    p = F.col("p")
    return shown.prediction_rows(rows.select("variant_key", F.when(p % 30 > 0, "amikacin").alias("drug"), F.when(p % 20 > 0, "likely_resistant").alias("prediction"), F.concat(F.lit("m"), (p % 4).cast("string")).alias("model_id"), F.when(p % 50 > 0, "v1").alias("model_version"), F.when(p % 70 == 0, "not approved").alias("violation")))


def panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 25").select(F.col("p_brand").alias("locus")).where("locus < 'Brand#3'")
    return shown.panel_rows(bound(spark, sf_dir, "profile"), panel).withColumn("missing", F.array_join("missing", ","))


def _readable(text: str) -> str:
    words = rf"list_filter(string_split_regex(regexp_replace(trim({text}), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[\s_\-./]+'), lambda w: w <> '')"
    capitals = "(w = upper(w) AND w <> lower(w))"
    codes = ", ".join(f"'{a}'" for a in ACRONYMS)
    one = f"""CASE WHEN lower(w) IN ({codes}) THEN upper(w) WHEN {capitals} AND length(w) <= 5 THEN w WHEN k = 1 THEN upper(w[1]) || CASE WHEN {capitals} THEN lower(w[2:]) ELSE w[2:] END WHEN w[2:] <> lower(w[2:]) THEN w ELSE lower(w) END"""
    return f"CASE WHEN len({words}) > 0 THEN array_to_string(list_transform({words}, lambda w, k: {one}), ' ') ELSE nullif(trim({text}), '') END"


def _name(text: str) -> str:
    return f"regexp_replace(nullif(trim({text}), ''), '^([^_]*)_', '\\1 ')"


def _or(text: str, default: str = "Not supplied") -> str:
    return f"coalesce({text}, '{default}')"


def _given(*columns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim({c}), '')" for c in columns) + ", NULL)"


def _percent(text: str) -> str:
    return f"CASE WHEN TRY_CAST({text} AS DOUBLE) <= 1 THEN round(TRY_CAST({text} AS DOUBLE) * 100, 2) ELSE round(TRY_CAST({text} AS DOUBLE), 2) END"


def _kinds(part) -> str:
    """A text for each kind of finding, with its gene and drug put in."""
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN '{part(t)}'" for k, t in mechanisms.TEMPLATES.items()) + " END"


def _filled(text: str) -> str:
    return f"replace(replace({text}, '{{gene}}', gene), '{{drug}}', drug)"


_QUEUE = """, hd AS (SELECT * FROM variants WHERE consequence IS DISTINCT FROM 'synonymous'),
mq AS (SELECT h.*, r.drug AS drug, CASE WHEN consequence = 'frameshift' THEN 'regulator lost' ELSE 'regulator altered' END AS kind, CASE WHEN consequence = 'frameshift' THEN 0 ELSE 1 END AS k FROM hd AS h JOIN (SELECT DISTINCT gene, drug FROM regulators) AS r ON r.gene = h.gene
  UNION ALL SELECT h.*, p.drug, 'upstream', 2 FROM hd AS h JOIN (SELECT DISTINCT gene, drug FROM promoters) AS p ON p.gene = h.gene WHERE region = 'promoter'),
m1 AS (SELECT sample_id, variant_key, drug, label, gene, kind FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, variant_key, drug ORDER BY k, label, gene) AS n FROM mq) WHERE n = 1),
""" + f"""mh AS (SELECT *, {_filled(_kinds(lambda t: t[0]))} AS hypothesis, {_kinds(lambda t: '; '.join(x[0] for x in t[1]))} AS gaps, {_filled(_kinds(lambda t: '; '.join(x[1] for x in t[1])))} AS experiments FROM m1)
"""
_REFUSED = """, un AS (SELECT g.isolate_id AS isolate_id, g.drug AS drug, coalesce(s.organism, '?') AS o, CASE WHEN coalesce(trim(subspecies), '') = '' THEN 1 ELSE 0 END AS a, CASE WHEN subspecies = 'massiliense' THEN 0 ELSE 1 END AS am, CASE WHEN erm41_status = 'nonfunctional' THEN 0 ELSE 1 END AS b, CASE WHEN rrl_status = 'wild_type' THEN 0 ELSE 1 END AS c
  FROM (SELECT DISTINCT isolate_id, drug FROM {pairs}) AS g LEFT JOIN states AS s ON s.isolate_id = g.isolate_id WHERE g.drug IN ('PROMO', 'LARGE')),
rf AS (SELECT isolate_id, drug, concat_ws(',', CASE WHEN drug = 'LARGE' AND am = 1 OR drug = 'PROMO' AND a = 1 THEN 'subspecies' END, CASE WHEN drug = 'PROMO' AND b = 1 THEN 'erm41_status' END, CASE WHEN drug = 'PROMO' AND c = 1 THEN 'rrl_status' END) AS unmet FROM un WHERE o IN ('mabscessus', '?')
  UNION ALL SELECT isolate_id, drug, CASE WHEN c = 1 THEN 'rrl_status' ELSE '' END FROM un WHERE o = 'mtbc' AND drug = 'PROMO'),
fu AS (SELECT * FROM rf WHERE unmet <> '')
"""
_PAGES = variant_lanes._MATCH + """, pc AS (SELECT sample_id, string_agg(c, ';' ORDER BY a, b) AS calls FROM (SELECT DISTINCT sample_id // 10 AS sample_id, """ + f"{_readable('drug')} AS a, {_readable('call')} AS b, {_readable('drug')} || '|' || {_readable('call')} || '|none' AS c FROM results) GROUP BY sample_id)," + f"""
pv AS (SELECT sample_id, label, gene, {_name('label')} AS v, {_readable('drug')} AS d, {_readable('call')} AS c, tier, row_number() OVER (PARTITION BY sample_id, label ORDER BY gene, {_readable('drug')}, {_readable('call')}, tier) AS n FROM ce),
pw AS (SELECT sample_id, string_agg(gene || '|' || v || '|' || d || '|' || c || '|' || tier, ';' ORDER BY gene, v) AS variants FROM pv WHERE n = 1 GROUP BY sample_id),
pl AS (SELECT isolate_id AS sample_id, string_agg(locus || '|' || CAST(mean_depth AS VARCHAR) || '|' || CAST(CAST(round(CAST(callable_fraction AS DOUBLE) * 100) AS BIGINT) AS VARCHAR), ';' ORDER BY locus) AS loci FROM coverage GROUP BY isolate_id),
px AS (SELECT i.isolate_id AS sample_id, CAST(site_id AS VARCHAR) AS site, lineage, organism FROM isolates AS i JOIN contexts AS c ON c.isolate_id = i.isolate_id),
pi AS (SELECT sample_id FROM pc UNION SELECT sample_id FROM pw UNION SELECT sample_id FROM pl UNION SELECT sample_id FROM px)
SELECT pi.sample_id AS sample_id, CAST(0 AS BIGINT) AS page, coalesce(site, 'Not recorded') AS site, coalesce(lineage, 'Untyped') AS lineage, coalesce(organism, 'Not recorded') AS organism, 'Unknown' AS assay, coalesce(calls, '') AS calls, coalesce(variants, '') AS variants, coalesce(loci, '') AS loci
FROM pi LEFT JOIN pc ON pc.sample_id = pi.sample_id LEFT JOIN pw ON pw.sample_id = pi.sample_id LEFT JOIN pl ON pl.sample_id = pi.sample_id LEFT JOIN px ON px.sample_id = pi.sample_id"""
_VERDICT = "coalesce(nullif(trim(verdict), ''), 'not supplied')"
_NONE = "'Not supplied' AS "


def _after(sql: str, name: str, query: str) -> str:
    """A further query over the rows that another SQL text states."""
    return f"WITH {name} AS ({sql}) {query}"


QUERIES = {f.__name__: f for f in (
    organism_refusals, organism_calls, mechanism_queue, mechanism_cards, sample_pages, model_rows, watch_rows, ticket_rows, target_rows, audit_rows, epistasis_rows, population_rows, concentration_rows, structural_rows,
    regulatory_rows, expression_rows, prediction_rows, panel_rows,
)}


def sql(reconciled: str, concentrations: str) -> dict[str, str]:
    """The SQL of the queries; ``reconciled`` and ``concentrations`` are that of the calls and the comparisons that are reused."""
    ruled = reconciled.replace("WHEN sp IS NOT NULL THEN 5", "WHEN fu.unmet IS NOT NULL THEN 9 WHEN sp IS NOT NULL THEN 5").replace("FROM gate LEFT JOIN fx", "FROM gate LEFT JOIN fu ON fu.isolate_id = gate.isolate_id AND fu.drug = gate.drug LEFT JOIN fx")
    ruled = ruled.replace("WHEN g = 6 THEN 'loci'", "WHEN g = 6 THEN 'loci' WHEN g = 9 THEN 'organism'").replace("FROM evidence AS e LEFT JOIN", "FROM (SELECT * FROM evidence WHERE call <> 'resistant' OR engine = 'e1') AS e LEFT JOIN")
    before, after = ruled.split(", ev AS (", 1)
    drugs = "(SELECT isolate_id, d AS drug FROM isolates CROSS JOIN (VALUES ('PROMO'), ('LARGE'), ('SMALL')) AS v(d))"
    tickets = report_views.SQL["discordance_tickets"]
    return {
        "organism_refusals": with_bindings("isolates states", _REFUSED.format(pairs=drugs) + "SELECT * FROM fu"),
        "organism_calls": with_bindings("isolates profile coverage evidence scopes contexts qc states", before + _REFUSED.format(pairs="gate") + ", ev AS (" + after + "SELECT * FROM rc"),
        "mechanism_queue": with_bindings("variants regulators promoters", _QUEUE + "SELECT * FROM mh"),
        "mechanism_cards": with_bindings("variants regulators promoters", _QUEUE + f"SELECT sample_id, variant_key, drug, {_name('label')} || ' - ' || {_readable('drug')} AS title, hypothesis || ' Missing: ' || gaps || ' Resolved by: ' || experiments AS body, 'Indeterminate;' || gene || ';evidence gap' AS tags FROM mh"),
        "sample_pages": with_bindings("variants entries results coverage isolates contexts", _PAGES),
        "model_rows": with_bindings("supplied_models", f""" SELECT {_or(_given('model', 'model_id'))} AS model, {_or(_given('version'))} AS version, {_NONE}cohort, {_or(_readable('drug'))} AS drug, {_or(_readable('lineage'), 'All lineages')} AS lineage, {_percent('call_rate')} AS call_rate, {_percent('error_rate')} AS error_rate, CAST(NULL AS DOUBLE) AS sensitivity,
  TRY_CAST(n_called AS BIGINT) AS n_called, CAST(NULL AS BIGINT) AS n_dropped, {_readable(_VERDICT)} AS verdict, lower(regexp_replace({_VERDICT}, '[_ ]', '-', 'g')) AS verdict_key, coalesce(lower(registry_ready) IN ('yes', 'true', '1'), false) AS registry_ready, {_or('reason')} AS notes FROM supplied_models"""),
        "watch_rows": _after(report_views.SQL["watch_list"], "wl", f"SELECT {_readable('drug')} AS drug, 'All variants of the drug' AS variant, unresolved_isolates, contributing_sites, 'Under investigation' AS status, {_NONE}source FROM wl"),
        "ticket_rows": _after(tickets, "tk", f"""SELECT substr(ticket_id, 1, 12) AS ticket, CAST(sample_id AS VARCHAR) AS sample, {_readable('drug')} AS drug, {_readable('genomic_call')} AS genomic_call, {_readable('phenotypic_call')} AS phenotypic_call, genomic_call AS genomic_key, phenotypic_call AS phenotypic_key,
  'Open' AS status, 'open' AS status_key, {_NONE}resolution, {_NONE}source FROM tk"""),
        "target_rows": with_bindings("supplied_targets", f""" SELECT {_given('target', 'gene')} AS target, {_or(_readable('essentiality'))} AS essentiality, {_or(_readable('druggability'))} AS druggability, {_or(_readable('human_homology'))} AS human_homology, {_NONE}resistance_liability, {_or('rationale')} AS evidence, {_NONE}source
FROM supplied_targets WHERE {_given('target', 'gene')} IS NOT NULL"""),
        "audit_rows": with_bindings("audit", f" SELECT CAST(NULL AS VARCHAR) AS at, {_readable(_given('action', 'event'))} AS event, {_or(_given('actor', 'reviewer'), 'unknown')} AS actor, coalesce(summary, '') AS target, substr(coalesce(entry_hash, ''), 1, 8) AS hash FROM audit"),
        "epistasis_rows": _after(report_views.SQL["co_observed_pairs"], "ep", f"SELECT CAST(sample_id AS VARCHAR) AS sample, CAST(rule AS VARCHAR) AS rule, {_NONE}source, {_readable('drug')} AS drug, 'Annotation only' AS interaction, {_name('key_a')} || ' + ' || {_name('key_b')} AS pair, 'Annotation only' AS effect FROM ep"),
        "population_rows": report_views._GROUPS.format(variants=BINDINGS["variants"]) + """, hn AS (SELECT sample_id, size, CASE WHEN sample_id % 2 = 0 THEN 'L' || CAST(size AS VARCHAR) ELSE 'L1' END AS l, CASE WHEN sample_id % 2 = 0 THEN 'L' || CAST(size AS VARCHAR) ELSE 'Not assigned' END AS s, CAST(round(round(m, 6) * 100000) AS BIGINT) AS f FROM gr)
SELECT sample_id, CASE WHEN COUNT(DISTINCT l) >= 2 THEN 'Possible coinfection' ELSE 'Indeterminate' END AS classification, CAST(COUNT(*) AS INTEGER) AS n_groups, string_agg(CAST(f AS VARCHAR) || '|' || CAST(size AS VARCHAR) || '|' || s, ';' ORDER BY f, size, s) AS groups FROM hn GROUP BY sample_id""",
        "concentration_rows": _after(concentrations, "cr", f"SELECT CAST(isolate_id AS VARCHAR) AS sample, trim(mic) AS value, {_NONE}method, {_NONE}source, {_readable('drug')} AS drug, CAST(NULL AS VARCHAR) AS unit, {_or(_readable('call'), 'Undecided')} AS comparison, false AS conflict FROM cr"),
        "structural_rows": with_bindings("structures", f""" SELECT {_or(_name('variant'))} AS variant, {_or('gene')} AS gene, {_NONE}effect, {_NONE}source, {_or(_readable('location'), 'Unknown')} AS location, coalesce(CAST(ligand_distance AS VARCHAR) || CASE WHEN distance_unit IS NOT NULL THEN ' ' || distance_unit ELSE '' END, 'Not measured') AS distance,
  {_or(_readable('status'), 'Unknown')} AS status, 'None' AS ranking_effect FROM structures"""),
        "regulatory_rows": _after(variant_lanes.SQL["regulatory_matches"], "rm", f""", ar AS ({BINDINGS['areas']}), rt AS (SELECT rm.*, a.area IS NOT NULL AS told, gene FROM rm LEFT JOIN ar AS a ON a.area = rm.area AND a.area % 7 > 0)
SELECT CAST(sample_id AS VARCHAR) AS sample, CAST(area AS VARCHAR) AS area, {_NONE}name, {_or('gene')} AS gene, {_name('variant_key')} AS variant, CASE WHEN NOT told THEN 'Unknown' ELSE CASE area % 4 WHEN 0 THEN 'Promoter region' WHEN 1 THEN 'Intergenic' WHEN 2 THEN 'Small RNA' ELSE 'Unknown' END END AS type, {_readable('matched_by')} AS matched_by FROM rt"""),
        "expression_rows": _after(report_views.SQL["expression_links"], "el", f"SELECT CAST(sample_id AS VARCHAR) AS sample, CAST(observation_id AS VARCHAR) AS observation, gene, {_NONE}source, 'Unknown' AS measurement, 'Uncertain' AS conclusion, {_readable('status')} AS matching, CASE WHEN drugs = '' THEN 'None' ELSE replace(upper(drugs), ',', ', ') END AS drugs FROM el"),
        "prediction_rows": with_bindings("variants", f""", vp AS (SELECT label, MIN(pos) AS p FROM variants GROUP BY label) SELECT {_name('label')} AS variant, CASE WHEN p % 30 > 0 THEN 'Amikacin' ELSE 'Not supplied' END AS drug, CASE WHEN p % 20 > 0 THEN 'Likely resistant' ELSE 'Uncertain' END AS prediction,
  'm' || CAST(p % 4 AS VARCHAR) || CASE WHEN p % 50 > 0 THEN ' v1' ELSE '' END AS model, 'All lineages' AS lineage, CASE WHEN p % 70 = 0 THEN 'Not approved' ELSE 'No call or ranking effect' END AS effect FROM vp"""),
        "panel_rows": with_bindings("profile", f""", pn AS (SELECT DISTINCT p_brand AS locus FROM part WHERE p_size > 25 AND p_brand < 'Brand#3'), pm AS (SELECT DISTINCT drug, p.locus AS locus, n.locus IS NOT NULL AS held FROM profile AS p LEFT JOIN pn AS n ON n.locus = p.locus)
SELECT {_readable('drug')} AS drug, COUNT(locus) AS n_loci, COUNT(CASE WHEN held THEN 1 END) AS n_kept, coalesce(string_agg(CASE WHEN NOT held THEN locus END, ',' ORDER BY locus), '') AS missing, COUNT(locus) > 0 AND COUNT(CASE WHEN NOT held AND locus IS NOT NULL THEN 1 END) = 0 AS supported FROM pm GROUP BY drug"""),
    }
