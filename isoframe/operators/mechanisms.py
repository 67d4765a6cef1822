"""What would settle an indeterminate regulator or promoter finding: hypotheses, gaps and experiments, one per drug."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.functions.display import readable, variant_name
from isoframe.functions.variants import TRUNCATING
from isoframe.operators.joins import sized
from isoframe.operators.lanes import SILENT

_EXPRESSION = ("pump expression against the wild type is not measured", "Measure pump expression of a {gene} mutant and of the wild type")
_INHIBITOR = ("the shift under a pump inhibitor is not measured", "Test {drug} with and without a pump inhibitor")
_ALLELE = ("the effect of this allele alone is not isolated", "Introduce the change of {gene} into a susceptible strain and test {drug}")
_REPORTER = ("the change of expression is not measured", "Quantify expression of {gene} by a reporter and test {drug}")
#: Per kind of finding: its hypothesis, and pairs of what is missing and what would supply it.
TEMPLATES = {
    "regulator lost": ("Losing {gene} may release its pump and raise the concentration of {drug} that is needed; nobody measured it.", (_EXPRESSION, _INHIBITOR)),
    "regulator altered": ("A changed {gene} may release its pump and raise the concentration of {drug} that is needed; nobody measured it.", (_EXPRESSION, _INHIBITOR, _ALLELE)),
    "upstream": ("A change upstream of {gene} may alter its expression and shift the effect of {drug}; its size is not measured.", (_REPORTER,)),
}
KINDS = tuple(TEMPLATES)


def mechanism_queue(variants: DataFrame, regulators: DataFrame, promoters: DataFrame) -> DataFrame:
    """One row per (sample_id, variant_key, drug) that ``lanes.regulator_evidence`` leaves indeterminate: label, gene, kind, hypothesis, gaps and experiments.

    ``variants`` has sample_id, variant_key, label, gene, region and consequence,
    ``regulators`` and ``promoters`` (gene, drug). Silent changes give nothing; one of
    unknown consequence counts as altered. A gene that regulates the drug goes before a
    place upstream of its target; of repeated rows the smallest label counts. Rows without
    a gene meet no drug. Nothing here changes a call. Repeated rows are combined before the
    shuffle, so a variant of any frequency is shared out.
    """
    heard = variants.where(f"NOT ({SILENT})")
    lost = F.coalesce(F.col("consequence").isin(*TRUNCATING), F.lit(False))
    met = lambda rows, targets: rows.join(sized(targets.select("gene", "drug").distinct()), "gene")
    pumps = met(heard, regulators).withColumn("_k", F.when(lost, 0).otherwise(1))
    upstream = met(heard.where("region IN ('promoter', 'intergenic')"), promoters).withColumn("_k", F.lit(2))
    first = pumps.unionByName(upstream).groupBy("sample_id", "variant_key", "drug").agg(F.min(F.struct("_k", "label", "gene")).alias("_f"))
    rows = first.select("sample_id", "variant_key", "drug", F.col("_f.label").alias("label"), F.col("_f.gene").alias("gene"), F.element_at(F.lit(list(KINDS)), F.col("_f._k") + 1).alias("kind"))

    told = lambda part: F.element_at(F.array(*[part(TEMPLATES[k]) for k in KINDS]), F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int"))
    named = lambda text: F.replace(F.replace(text, F.lit("{gene}"), F.col("gene")), F.lit("{drug}"), F.col("drug"))
    texts = lambda n: told(lambda t: F.array(*[F.lit(x[n]) for x in t[1]]))
    return rows.withColumns({"hypothesis": named(told(lambda t: F.lit(t[0]))), "gaps": texts(0), "experiments": F.transform(texts(1), named)})


def mechanism_cards(queue: DataFrame) -> DataFrame:
    """A card for each row of ``mechanism_queue``: title, body and tags (an array: the call, the gene, whether a gap is named)."""
    listed = lambda word, c: F.when(F.size(c) > 0, F.concat(F.lit(f" {word}: "), F.array_join(c, "; "))).otherwise("")
    title = F.concat_ws(" - ", variant_name(F.col("label")), readable(F.col("drug")))
    tags = F.array_compact(F.array(F.lit("Indeterminate"), F.col("gene"), F.when(F.size("gaps") > 0, "evidence gap")))
    return queue.select("sample_id", "variant_key", "drug", title.alias("title"), F.concat("hypothesis", listed("Missing", "gaps"), listed("Resolved by", "experiments")).alias("body"), tags.alias("tags"))
