"""Graded catalogues: ingest, candidates for a scan, and evidence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: grades (in lower case) and the calls they stand for.
GRADES = {
    "1) assoc w r": "resistant", "2) assoc w r - interim": "resistant", "3) uncertain significance": "indeterminate",
    "4) not assoc w r - interim": "not_associated", "5) not assoc w r": "not_associated",
}


def graded(master: DataFrame) -> DataFrame:
    """Add call and skip_reason: rows without gene, change or drug and rows of an unknown grade are skipped with a reason."""
    call = F.lit(None).cast("string")
    for grade, value in GRADES.items():
        call = F.when(F.lower(F.trim("grade")) == grade, value).otherwise(call)
    blank = F.lit(False)
    for c in ("gene", "change", "drug"):
        blank = blank | (F.coalesce(F.trim(c), F.lit("")) == "")
    return master.withColumn("call", call).withColumn("skip_reason", F.when(blank, "incomplete").when(F.col("call").isNull(), "unknown grade"))


def ingest(master: DataFrame) -> DataFrame:
    """One row per (gene, change): its drugs, and the call that any drug makes resistant, else indeterminate, else not associated."""
    rows = graded(master).where("skip_reason IS NULL")
    has = lambda call: F.max(F.when(F.col("call") == call, 1).otherwise(0)) == 1
    call = F.when(has("resistant"), "resistant").when(has("indeterminate"), "indeterminate").otherwise("not_associated")
    return rows.groupBy("gene", "change").agg(F.array_join(F.sort_array(F.collect_set("drug")), ",").alias("drugs"), call.alias("call")).withColumn(
        "label", F.concat("gene", F.lit("_"), "change")
    )


def skipped(master: DataFrame) -> DataFrame:
    """Rows that were not taken, by reason."""
    return graded(master).where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n"))


def coordinate_keys(coordinates: DataFrame, assembly: str) -> DataFrame:
    """(variant, keys, coordinate_key): the places of a variant as ``assembly:Chromosome:position:ref>alt``, in order of ``line``.

    ``coordinates`` has variant, chromosome (blank: ``assembly``), position, ref, alt and
    line. A variant may have several spellings, and all are kept. Rows without a variant
    or a position of digits count for nothing, rows without ref or alt give no key.
    """
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    good = coordinates.where((text("variant") != "") & text("position").rlike("^[0-9]+$") & (text("ref") != "") & (text("alt") != ""))
    place = F.when(text("chromosome") == "", assembly).otherwise(text("chromosome"))
    key = F.concat(place, F.lit(":Chromosome:"), text("position").cast("long").cast("string"), F.lit(":"), text("ref"), F.lit(">"), text("alt"))
    listed = good.groupBy(text("variant").alias("variant")).agg(F.array_sort(F.collect_list(F.struct("line", key.alias("key")))).alias("_l"))
    keys = F.transform("_l", lambda x: x["key"])
    return listed.select("variant", keys.alias("keys"), F.get(keys, F.lit(0)).alias("coordinate_key"))


def with_coordinates(master: DataFrame, coordinates: DataFrame, order: str, assembly: str = "NC_000962.3") -> DataFrame:
    """Entries of ``ingest`` with variant (that of their first row by ``order``), coordinate_key and keys (null, none: without a place).

    ``master`` has gene, change, drug, grade, variant and ``order``; rows that ingest skips name no variant.
    """
    first = graded(master).where("skip_reason IS NULL").groupBy("gene", "change").agg(F.min_by(F.trim("variant"), order).alias("variant"))
    entries = ingest(master).join(first.hint("merge"), ["gene", "change"])
    out = entries.join(coordinate_keys(coordinates, assembly).hint("merge"), "variant", "left")
    return out.withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))


def drug_tiers(master: DataFrame) -> DataFrame:
    """Per drug the genes of tier 1 and of tier 2, sorted; whatever the grade, rows without gene, change or drug left out.

    A drug whose rows name neither tier has no row.
    """
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    whole = master.where((text("gene") != "") & (text("change") != "") & (text("drug") != "") & text("tier").isin("1", "2"))
    genes = lambda t: F.array_sort(F.collect_set(F.when(text("tier") == t, text("gene")))).alias(f"tier{t}")
    return whole.groupBy(F.lower(text("drug")).alias("drug")).agg(genes("1"), genes("2"))
