"""Outputs of prediction tools, many files at once, as rows of evidence.

Loaders take texts (file, value: the whole file) and return rows and failures. A file
whose layout or codes are not known fails as a whole, with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoframe.functions.variants import named

#: Grades and codes of the tools, and drugs of wide tables (null: kept apart, not compared).
GRADE_CALLS = {
    "assoc w r": "resistant", "assoc w r - interim": "resistant", "1) assoc w r": "resistant", "2) assoc w r - interim": "resistant",
    "uncertain significance": "indeterminate", "3) uncertain significance": "indeterminate", "not assoc w r": "susceptible",
    "not assoc w r - interim": "susceptible", "4) not assoc w r - interim": "susceptible", "5) not assoc w r": "susceptible",
}
PROBE_CODES = {"R": "resistant", "r": "resistant", "S": "susceptible", "N": "not_assessed", "U": "indeterminate"}
DISCRETE_CODES = {"R": "resistant", "S": "susceptible", "U": "indeterminate", "F": "no_call", "N": "no_call"}
CLASS_DRUGS = {"macrolides": "clarithromycin", "amikacin": "amikacin"}
#: Fixed: cells of a wide table that say that nothing was found.
EMPTY_CELLS = ("", "-", "NA", "None")
CALL_ORDER = ("resistant", "indeterminate", "no_call", "susceptible", "not_assessed")
REFERENCES = ("NC_000962.3", "AL123456.3")


def _code(value: Column, codes: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), value)


def _once(parsed: Column) -> Column:
    """The value of a parsed text as a generated column, so that filters on it do not parse the text again."""
    return F.explode(F.array(parsed))


def _parted(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files without an error, and failures (file, reason)."""
    return parsed.where("error IS NULL").drop("error"), parsed.where("error IS NOT NULL").select("file", F.col("error").alias("reason"))


_GRADED = (
    "array<struct<gene: string, gene_name: string, locus_tag: string, change: string, protein_change: string, nucleotide_change: string, freq: double, depth: double, "
    "drugs: array<struct<drug: string, confidence: string, who_confidence: string>>>>"
)
_COVERED = "array<struct<gene: string, fraction: double, median_depth: double>>"
_GRADED_FILE = f"_corrupt_record string, id string, sample_name string, main_lin string, sublin string, dr_variants {_GRADED}, drug_resistance_variants {_GRADED}, qc struct<gene_coverage: {_COVERED}, target_coverage: {_COVERED}>"


def _graded_files(texts: DataFrame) -> DataFrame:
    parsed = texts.select("*", _once(F.from_json("value", _GRADED_FILE)).alias("_d"))
    found = F.coalesce("_d.dr_variants", "_d.drug_resistance_variants")
    error = F.when(F.col("_d").isNull() | F.col("_d._corrupt_record").isNotNull(), "not JSON").when(found.isNull(), "no list of resistance variants")
    return parsed.select("file", F.coalesce("_d.id", "_d.sample_name").alias("sample_id"), F.coalesce("_d.sublin", "_d.main_lin").alias("lineage"), found.alias("_found"), F.col("_d.qc").alias("_qc"), error.alias("error"))


def load_graded(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of graded results JSON: file, sample_id, lineage, gene, change, vaf, depth, drug, grade, call, tier.

    Keys have aliases. A grade that is not known is indeterminate, and resistance without
    a grade is not established.
    """
    files, failed = _parted(_graded_files(texts))
    v = files.select("file", "sample_id", "lineage", F.explode("_found").alias("v"))
    first = lambda *names: F.coalesce(*[F.nullif(F.col(f"v.{n}"), F.lit("")) for n in names])
    rows = v.select("file", "sample_id", "lineage", first("gene", "gene_name", "locus_tag").alias("gene"), first("change", "protein_change", "nucleotide_change").alias("change"), F.col("v.freq").alias("vaf"), F.col("v.depth").cast("long").alias("depth"), F.explode("v.drugs").alias("a"))
    grade = F.nullif(F.trim(F.coalesce("a.confidence", "a.who_confidence")), F.lit(""))
    call = F.coalesce(named(grade, GRADE_CALLS), F.lit("indeterminate"))
    rows = rows.where("gene IS NOT NULL AND change IS NOT NULL AND trim(a.drug) <> ''")
    return rows.select("file", "sample_id", "lineage", "gene", "change", "vaf", "depth", F.lower(F.trim("a.drug")).alias("drug"), grade.alias("grade"), call.alias("call"), F.when(grade.isNotNull(), "catalogued").otherwise("none").alias("tier")), failed


def graded_status(texts: DataFrame) -> DataFrame:
    """file, status and reason of graded results files: failed (not readable), ok (``load_graded`` finds rows) or skipped; each file is parsed once."""
    first = lambda v, *names: F.coalesce(*[F.nullif(v[n], F.lit("")) for n in names])
    named = lambda v: first(v, "gene", "gene_name", "locus_tag").isNotNull() & first(v, "change", "protein_change", "nucleotide_change").isNotNull()
    told = lambda v: F.coalesce(F.exists(v["drugs"], lambda a: F.coalesce(F.trim(a["drug"]) != "", F.lit(False))), F.lit(False))
    found = F.coalesce(F.exists("_found", lambda v: named(v) & told(v)), F.lit(False))
    failed = F.col("error").isNotNull()
    status = F.when(failed, "failed").when(found, "ok").otherwise("skipped")
    return _graded_files(texts).select("file", status.alias("status"), F.when(failed, F.col("error")).when(found, "").otherwise("no rows").alias("reason"))


def graded_coverage(texts: DataFrame) -> DataFrame:
    """Locus coverage that graded results carry: sample_id, locus, mean_depth, callable_fraction (values above 1 are per cent)."""
    files, _ = _parted(_graded_files(texts))
    rows = files.select("sample_id", F.explode(F.coalesce("_qc.gene_coverage", "_qc.target_coverage")).alias("c")).where("c.gene IS NOT NULL")
    fraction = F.col("c.fraction")
    return rows.select("sample_id", F.col("c.gene").alias("locus"), F.col("c.median_depth").cast("long").alias("mean_depth"), F.when(fraction > 1, fraction / 100).otherwise(fraction).alias("callable_fraction"))


def load_probes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of probe predictions keyed by sample: file, sample_id, drug, code, call, tier, asserts_coverage, called_by.

    One sample a file; an unknown code fails the file. Only S asserts coverage.
    """
    parsed = texts.select("*", _once(F.from_json("value", "map<string, struct<susceptibility: map<string, struct<predict: string, called_by: map<string, string>>>>>")).alias("_d"))
    sample = F.get(F.map_keys("_d"), F.lit(0))
    entries = F.get(F.map_values("_d"), F.lit(0))["susceptibility"]
    unknown = F.exists(F.map_values(entries), lambda e: _code(F.trim(F.coalesce(e["predict"], F.lit(""))), PROBE_CODES).isNull())
    error = F.when(F.col("_d").isNull(), "not JSON").when(F.size("_d") != 1, "not one sample").when(entries.isNull(), "no susceptibility").when(unknown, "unknown code")
    files, failed = _parted(parsed.select("file", sample.alias("sample_id"), entries.alias("_e"), error.alias("error")))
    rows = files.select("file", "sample_id", F.explode("_e").alias("drug", "e")).withColumn("code", F.trim("e.predict"))
    called = F.array_join(F.sort_array(F.coalesce(F.map_keys("e.called_by"), F.array().cast("array<string>"))), ", ")
    tier = F.when(F.col("code").isin("R", "r", "S"), "catalogued").otherwise("none")
    return rows.select("file", "sample_id", F.lower(F.trim("drug")).alias("drug"), "code", _code(F.col("code"), PROBE_CODES).alias("call"), tier.alias("tier"), (F.col("code") == "S").alias("asserts_coverage"), called.alias("called_by")), failed


def load_antibiograms(texts: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of discrete antibiograms: file, sample_id, drug, code, call, asserts_coverage (never).

    ``bindings`` (file, sample_id) says whose file it is; a file without one, one that
    names another sample, another workflow or reference, and an unknown code fail.
    """
    kind = "meta struct<workflow_name: string, status: string, sample_id: string, guid: string, reference: string, catalogue_type: string>, data struct<antibiogram: map<string, string>>"
    parsed = texts.select("*", _once(F.from_json("value", kind)).alias("_d")).join(bindings.hint("merge"), "file", "left")
    meta, codes = F.col("_d.meta"), F.col("_d.data.antibiogram")
    other = lambda c: (F.coalesce(meta[c], F.lit("")) != "") & (meta[c] != F.col("sample_id"))
    error = (
        F.when(meta.isNull() | codes.isNull(), "no meta or antibiogram")
        .when(~meta["workflow_name"].eqNullSafe("gnomonicus") | ~meta["status"].eqNullSafe("success") | ~F.coalesce(meta["catalogue_type"].rlike("^[RSUFN]+$"), F.lit(False)), "not a discrete prediction")
        .when(F.col("sample_id").isNull(), "no sample binding").when(other("sample_id") | other("guid"), "sample binding conflicts")
        .when(~F.coalesce(meta["reference"].isin(*REFERENCES), F.lit(False)), "unknown reference").when(F.exists(F.map_values(codes), lambda c: _code(c, DISCRETE_CODES).isNull()), "unknown code")
    )
    files, failed = _parted(parsed.select("file", "sample_id", codes.alias("_c"), error.alias("error")))
    rows = files.select("file", "sample_id", F.explode("_c").alias("drug", "code"))
    return rows.select("file", "sample_id", F.lower("drug").alias("drug"), "code", _code(F.col("code"), DISCRETE_CODES).alias("call"), F.lit(False).alias("asserts_coverage")), failed


def load_species_profiles(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of profiles of one species: file, sample_id, subspecies, erm41_status, gene, change, drug, call (indeterminate), tier.

    More or less than one species, another species and missing lists fail. A subspecies
    counts if it is the only one at full frequency; drugs that are not mapped have no row.
    """
    item = "array<struct<gene: string, change: string, filter: string, drugs: array<struct<drug: string, type: string>>>>"
    kind = (
        f"id string, dr_variants {item}, other_variants {item}, dr_genes array<struct<gene_name: string, type: string, filter: string>>, "
        "species struct<species: array<struct<species: string>>>, barcode array<struct<id: string, frequency: double>>"
    )
    parsed = texts.select("*", _once(F.from_json("value", kind)).alias("_d"))
    names = F.col("_d.species.species")
    error = (
        F.when(F.col("_d.id").isNull(), "no id").when(F.col("_d.dr_variants").isNull() | F.col("_d.dr_genes").isNull() | F.col("_d.other_variants").isNull(), "missing list")
        .when(F.coalesce(F.size(names), F.lit(0)) != 1, "species absent or mixed").when(~F.coalesce(F.lower(F.get(names, F.lit(0))["species"]).contains("abscessus"), F.lit(False)), "other species")
    )
    sub = F.filter("_d.barcode", lambda b: b["id"].startswith("subsp. ") & (b["frequency"] == 1))
    normal = F.exists("_d.dr_genes", lambda g: (g["gene_name"] == "erm(41)") & (F.lower(g["filter"]) == "pass") & (g["type"] == "functionally_normal"))
    files, failed = _parted(parsed.select(
        "file", F.col("_d.id").alias("sample_id"), F.when(F.size(sub) == 1, F.regexp_replace(F.get(sub, F.lit(0))["id"], "^subsp\\. ", "")).alias("subspecies"), F.when(normal, "functional").alias("erm41_status"),
        F.concat("_d.dr_variants", "_d.other_variants").alias("_v"), error.alias("error"),
    ))
    rows = files.select("file", "sample_id", "subspecies", "erm41_status", F.explode("_v").alias("v"))
    rows = rows.select("file", "sample_id", "subspecies", "erm41_status", "v.gene", "v.change", F.explode("v.drugs").alias("a"))
    return rows.withColumn("drug", _code(F.col("a.drug"), CLASS_DRUGS)).where("drug IS NOT NULL").drop("a").withColumns({"call": F.lit("indeterminate"), "tier": F.lit("inferred")}), failed


def load_gene_hits(rows: DataFrame, min_identity: float = 90.0, min_coverage: float = 90.0) -> tuple[DataFrame, DataFrame]:
    """Evidence of gene finder rows at class level, never resistant, and rows that are left out with the reason.

    ``rows`` has gene, element_type, element_subtype, class, subclass, identity and
    coverage. Hits below either limit keep no tier.
    """
    group = F.lower(F.trim(F.coalesce(F.nullif(F.trim("subclass"), F.lit("")), F.col("class"), F.lit(""))))
    kind = F.upper(F.trim(F.coalesce("element_type", F.lit(""))))
    reason = F.when(kind != "AMR", "other element").when(F.coalesce(F.trim("gene"), F.lit("")) == "", "no gene").when(group == "", "no class")
    marked = rows.withColumns({"_reason": reason, "drug": group})
    weak = F.coalesce(F.col("identity") < min_identity, F.lit(False)) | F.coalesce(F.col("coverage") < min_coverage, F.lit(False))
    kept = marked.where("_reason IS NULL").drop("_reason").withColumns({
        "call": F.lit("indeterminate"), "tier": F.when(weak, "none").otherwise("catalogued"), "scope": F.lit("determinant"), "point": F.upper(F.trim("element_subtype")) == "POINT",
    })
    return kept, marked.where("_reason IS NOT NULL").select(*rows.columns, F.col("_reason").alias("reason"))


def collate_long(wide: DataFrame, drugs: dict[str, str | None], sample: str = "sample") -> DataFrame:
    """Rows (sample, drug, compared, gene, change, freq) of a wide table whose drug columns hold ``gene change (freq), …`` cells.

    ``drugs`` maps columns to drugs; a column mapped to none keeps its own name and is
    not compared. Cells of -, NA, None or blank, and parts that are no variant, have no row.
    """
    cells = F.array(*[F.struct(F.lit(drugs[c] or c).alias("drug"), F.lit(drugs[c] is not None).alias("compared"), F.col(c).alias("cell")) for c in wide.columns if c in drugs])
    long = wide.where(F.trim(sample) != "").select(F.trim(sample).alias("sample"), F.explode(cells).alias("c")).select("sample", "c.*")
    filled = long.where(~F.coalesce(F.trim("cell"), F.lit(EMPTY_CELLS[0])).isin(*EMPTY_CELLS))
    words = F.filter(F.split(F.col("_p"), r"\s+"), lambda w: w != "")
    part = filled.select("sample", "drug", "compared", F.explode(F.split("cell", ",")).alias("_p")).withColumn("_w", words).where(F.size("_w").isin(2, 3))
    # A third word is the frequency in brackets; anything else there is no variant.
    tail = F.get("_w", F.lit(2))
    inner = tail.substr(F.lit(2), F.length(tail) - 2)
    number = tail.startswith("(") & tail.endswith(")") & (inner != "") & (F.translate(inner, "0123456789.", "") == "")
    freq = F.when(number, inner.try_cast("double"))
    return part.where(tail.isNull() | number).select("sample", "drug", "compared", F.get("_w", F.lit(0)).alias("gene"), F.get("_w", F.lit(1)).alias("change"), freq.alias("freq"))


def detected(findings: DataFrame, samples: DataFrame, drugs: list[str]) -> DataFrame:
    """sample, drug and call of every compared drug: resistant where anything was found, else not_assessed, never susceptible."""
    found = findings.where("compared").select("sample", "drug").distinct().withColumn("_found", F.lit(True))
    every = samples.select("sample", F.explode(F.lit(drugs)).alias("drug"))
    return every.join(found.hint("merge"), ["sample", "drug"], "left").select("sample", "drug", F.when(F.col("_found"), "resistant").otherwise("not_assessed").alias("call"))


def distinct_variants(findings: DataFrame, minority: float = 0.9) -> DataFrame:
    """sample, gene, change, freq and whether it is a minority allele, once for each variant."""
    out = findings.groupBy("sample", "gene", "change").agg(F.max("freq").alias("freq"))
    return out.withColumn("minority", F.coalesce(F.col("freq") < minority, F.lit(False)))


def strongest_call(evidence: DataFrame, by: list[str]) -> DataFrame:
    """One call per key: resistant, indeterminate, no_call, susceptible, not_assessed, in that order."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CALL_ORDER]), F.col("call"))
    return evidence.groupBy(*by).agg(F.min_by("call", F.when(rank > 0, rank).otherwise(len(CALL_ORDER) + 1)).alias("call"))
