"""Annotated variant text: records with gene, change and effect in INFO, with every refusal kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.functions.alleles import trimmed
from isoframe.functions.variants import consequence_of, region_of

#: Structural kinds that disrupt a gene, and how symbolic alleles start.
DISRUPTING = ("DEL", "INS", "DUP", "INV", "BND", "CNV")
SYMBOLIC = r"^[<\[\]*]"
ACCEPTED = ("PASS", ".")


def _numbers(text: Column) -> Column:
    numbers = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    return F.when(text.isNull(), F.array().cast("array<double>")).otherwise(numbers)


def file_facts(lines: DataFrame) -> DataFrame:
    """Per file: sample_id, platform, assembly and sample columns of its header, and error where there is no header."""
    v, low = F.col("value"), F.lower("value")
    after = F.trim(F.substring_index(v, "=", -1))
    heads = lines.where("startswith(value, '#')").groupBy("file").agg(
        F.max(F.when(v.startswith("##sampleID="), after)).alias("named"), F.max(F.when(low.startswith("##platform="), after)).alias("platform"),
        F.max(F.when(low.startswith("##reference="), after)).alias("assembly"), F.max(F.when(v.startswith("#CHROM"), v)).alias("_head"),
    )
    columns = F.split("_head", "\t")
    return heads.withColumn("samples", F.when(F.col("_head").isNotNull(), F.slice(columns, F.lit(10), F.greatest(F.size(columns) - 9, F.lit(0))))).drop("_head")


def load(lines: DataFrame, sample: str | None = None, default_assembly: str = "NC_000962.3") -> tuple[DataFrame, DataFrame]:
    """(variants, rejects) of lines (file, value).

    One row per ALT allele: file, sample_id, platform, gene, chrom, pos, ref, alt, change,
    region, consequence, vaf, depth, alt_depth, filters. ``rejects`` has file, value and
    reason: too few columns, a structural record without an interpretable gene, no or a
    symbolic allele. A file without a header line, one of several samples without a
    choice, and one that lacks the chosen sample are refused as a whole (value null).
    The fraction is AF (one value serves all alleles), else alternate over total depth;
    the depth is DP, else the sum of AD.
    """
    facts = file_facts(lines)
    wanted = F.lit(sample).cast("string")
    refused = (
        F.when(F.col("samples").isNull(), "no header").when(F.lit(sample is None) & (F.size("samples") > 1), "several samples")
        .when(F.lit(sample is not None) & (F.size("samples") > 0) & ~F.array_contains("samples", F.lit(sample or "")), "sample absent")
    )
    facts = facts.withColumn("refused", refused)
    files = lines.select("file").distinct().join(facts.hint("merge"), "file", "left").withColumn("refused", F.when(F.col("samples").isNull(), "no header").otherwise(F.col("refused")))  # for rejects only: a file without header lines has no facts
    place = F.when(F.lit(sample is not None), F.array_position("samples", F.lit(sample or ""))).otherwise(1)
    body = lines.where("NOT startswith(value, '#') AND trim(value) <> ''").join(facts.where("samples IS NOT NULL AND refused IS NULL").hint("merge"), "file")
    f = lambda k: F.get("_f", F.lit(k))
    body = body.withColumn("_f", F.split("value", "\t"))
    info = F.map_from_entries(F.transform(F.array_distinct(F.filter(F.split(f(7), ";"), lambda x: x.contains("="))), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring_index(x, "=", -1).alias("v"))))
    # Each split is a column of its own, made before it is used: a generator computes what stands inside it as often as it is named.
    body = body.withColumns({
        "_i": F.when(F.size("_f") >= 8, info), "_alts": F.filter(F.transform(F.split(f(4), ","), lambda x: F.trim(x)), lambda x: x != ""),
        "_keys": F.when(F.size("_f") >= 10, F.split(f(8), ":")), "_values": F.when(F.size("_f") >= 10, F.split(F.get("_f", (8 + place).cast("int")), ":")),
    })
    i = lambda k: F.nullif(F.try_element_at("_i", F.lit(k)), F.lit(""))
    kind = F.upper(F.coalesce(i("SVTYPE"), F.lit("")))
    structural = (kind != "") | (F.map_contains_key("_i", "END") & (F.trim(f(4)) == ""))
    alts = F.col("_alts")
    reason = (
        F.when(F.size("_f") < 8, "fewer than 8 columns").when(structural & (i("GENE").isNull() | ~kind.isin(*DISRUPTING)), "structural without gene")
        .when(~structural & (F.size(alts) == 0), "no alternate allele")
    )
    fmt = lambda k: F.nullif(F.get("_values", F.nullif(F.array_position("_keys", k), F.lit(0)).cast("int") - 1), F.lit(""))
    body = body.withColumns({"_structural": structural, "_kind": kind, "_af": F.coalesce(fmt("AF"), i("AF")), "_ad": fmt("AD"), "_dp": F.coalesce(fmt("DP"), i("DP")).try_cast("long"), "_reason": reason})
    body = body.withColumns({"_af": _numbers(F.col("_af")), "_ad": _numbers(F.col("_ad")), "_alts": F.when(F.col("_structural"), F.array(F.lit("."))).otherwise(alts)})
    parts = F.struct(*[F.col(f"_{c}").alias(c) for c in ("alts", "af", "ad", "dp", "structural", "kind", "reason")])
    parsed = body.withColumn("_p", F.explode(F.array(parts)))  # no filter is moved below this, where it would parse again
    named = F.coalesce(wanted, "named", F.get("samples", F.lit(0)), F.lit("sample"))
    head = parsed.select(
        "file", "value", named.alias("sample_id"), "platform", F.coalesce("assembly", F.lit(default_assembly)).alias("assembly"), f(0).alias("chrom"), f(1).try_cast("long").alias("pos"), f(3).alias("ref"),
        F.coalesce(i("GENE"), f(0)).alias("gene"), i("AACHANGE").alias("aa"), i("HGVS_P").alias("hgvs_p"), i("HGVS_C").alias("hgvs_c"), i("REGION").alias("said_region"), i("EFFECT").alias("effect"),
        F.filter(F.split(F.coalesce(f(6), F.lit("")), ";"), lambda x: x != "").alias("filters"), "_p.*",
    )
    symbolic = lambda x: ~F.col("structural") & x.rlike(SYMBOLIC)
    reasons = F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(F.transform(F.filter("alts", symbolic), lambda x: F.lit("symbolic allele")))
    rejects = (
        files.where("refused IS NOT NULL").select("file", F.lit(None).cast("string").alias("value"), F.col("refused").alias("reason"))
        .unionByName(head.select("file", "value", F.explode(reasons).alias("reason")))
    )
    rows = head.where("reason IS NULL").select("*", F.posexplode("alts").alias("_k", "alt"))
    kept = rows.where(~F.coalesce(symbolic(F.col("alt")), F.lit(False))).withColumn("_t", F.when(F.col("pos").isNotNull() & ~F.col("structural"), trimmed(F.col("pos"), F.col("ref"), F.col("alt"))))
    alleles = kept.withColumns({
        "pos": F.coalesce("_t.pos", "pos"), "ref": F.when(~F.col("structural"), F.coalesce("_t.ref", "ref")), "alt": F.when(~F.col("structural"), F.coalesce("_t.alt", "alt")),
    })
    spelled = F.when(F.col("pos").isNotNull(), F.concat("ref", F.col("pos").cast("string"), "alt"))
    change = F.when(F.col("structural"), F.coalesce("aa", F.concat(F.lower("kind"), F.lit("_disruption")))).otherwise(F.coalesce("aa", "hgvs_p", "hgvs_c", spelled))
    region = region_of(F.col("said_region"), F.when(F.col("structural"), F.col("change")).otherwise(F.col("aa")))
    at, n = F.col("_k"), F.size("alts")
    alt_depth = F.when(~F.col("structural") & (F.size("ad") >= n + 1), F.get("ad", at + 1).cast("long"))
    depth = F.coalesce("dp", F.when(F.size("ad") >= n + 1, F.aggregate("ad", F.lit(0.0), lambda a, x: a + x).cast("long")))
    given = F.when(at < F.size("af"), F.get("af", at)).when(F.size("af") == 1, F.get("af", F.lit(0)))
    out = alleles.withColumn("change", change).withColumn("region", region).withColumns({"alt_depth": alt_depth, "depth": depth})
    broken = F.when(F.col("kind").isin("INS", "DUP"), "insertion").otherwise("deletion")
    return out.select(
        "file", "sample_id", "platform", "assembly", "gene", "chrom", "pos", "ref", "alt", "change", "region",
        F.when(F.col("structural"), broken).otherwise(consequence_of(F.col("effect"), F.col("change"), F.col("region"))).alias("consequence"),
        F.when(~F.col("structural"), F.coalesce(given, F.when(F.col("depth") > 0, F.col("alt_depth") / F.col("depth")))).alias("vaf"), "depth", "alt_depth", F.array_join("filters", ";").alias("filters"),
    ), rejects


def gated(variants: DataFrame, floor: int = 10) -> DataFrame:
    """Add drop_reason: a filter that is not passed, else a known depth below the floor; kept rows have none, and an unknown depth passes."""
    bad = F.size(F.filter(F.split(F.coalesce("filters", F.lit("")), ";"), lambda x: (x != "") & ~x.isin(*ACCEPTED))) > 0
    return variants.withColumn("drop_reason", F.when(bad, "filter").when(F.col("depth") < floor, "depth"))


def from_table(rows: DataFrame) -> DataFrame:
    """Variants of a table with gene and change (both required) and optional vaf, depth, region, consequence, platform."""
    missing = [c for c in ("gene", "change") if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {rows.columns}")
    have = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    named = rows.where("trim(gene) <> '' AND trim(change) <> ''").withColumn("_r", region_of(have("region"), F.col("change")))
    others = [c for c in rows.columns if c not in ("gene", "change", "vaf", "depth", "region", "consequence", "platform")]
    return named.select(*others, F.trim("gene").alias("gene"), F.trim("change").alias("change"), have("vaf").try_cast("double").alias("vaf"), have("depth").try_cast("long").alias("depth"), F.col("_r").alias("region"), consequence_of(have("consequence"), F.col("change"), F.col("_r")).alias("consequence"), have("platform").alias("platform"))


def union_first(inputs: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of several inputs, one for each key: that of the earliest input, ties by the other columns in order of name."""
    whole = inputs[0].withColumn("_input", F.lit(0))
    for k, df in enumerate(inputs[1:], 1):
        whole = whole.unionByName(df.withColumn("_input", F.lit(k)), allowMissingColumns=True)
    rest = sorted(c for c in whole.columns if c not in (*keys, "_input"))
    return whole.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_input", *rest))).where("_n = 1").drop("_n", "_input")
