"""What a catalogue alone answers for a cohort, and how well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.functions.variants import locus_of

NO_DETERMINANTS, INCOMPLETE = "no determinants", "incomplete"


def predictions(truths: DataFrame, carriage: DataFrame, assessed: DataFrame, determinants: DataFrame, least: float = 0.95) -> DataFrame:
    """Every (isolate, drug) with a truth: predicted R, S or null, and the reason of an abstention.

    ``truths`` has isolate_id, drug and truth. R where a determinant of the drug is
    carried; S where determinants' loci were examined to the share ``least``; the
    catalogue abstains otherwise, and for a drug without determinants.
    """
    own = determinants.select("drug", "label").distinct()
    carried = carriage.join(own.hint("merge"), "label").select("isolate_id", "drug").distinct().withColumn("_carried", F.lit(True))
    loci = own.select("drug", locus_of(F.col("label")).alias("locus")).distinct()
    sizes = loci.groupBy("drug").agg(F.count("*").alias("_loci"))
    seen = assessed.select("isolate_id", locus_of(F.col("label")).alias("locus")).distinct().join(loci.hint("merge"), "locus").groupBy("isolate_id", "drug").agg(F.count("*").alias("_seen"))
    out = truths.join(sizes.hint("merge"), "drug", "left").join(carried.hint("merge"), ["isolate_id", "drug"], "left").join(seen.hint("merge"), ["isolate_id", "drug"], "left")
    examined = F.coalesce("_seen", F.lit(0)) / F.col("_loci") >= least
    predicted = F.when(F.col("_carried"), "R").when(examined, "S")
    reason = F.when(F.col("_loci").isNull(), NO_DETERMINANTS).when(predicted.isNull(), INCOMPLETE)
    return out.select(*truths.columns, predicted.alias("predicted"), reason.alias("abstained"))


def measure(found: DataFrame, determinants: DataFrame, min_answered: int = 10) -> DataFrame:
    """Per drug: answers, errors by direction, abstentions by reason, coverage and error rate.

    The error rate is 0 and not estimable below ``min_answered`` answers.
    """
    right = F.col("predicted") == F.col("truth")
    n = lambda c: F.count(F.when(c, 1))
    out = found.groupBy("drug").agg(
        F.count("*").alias("n_isolates"), F.count("predicted").alias("n_answered"), n(~right).alias("n_errors"), n(F.col("truth") == "R").alias("n_resistant_truth"),
        n(F.col("truth") == "S").alias("n_susceptible_truth"), n(~right & (F.col("predicted") == "R")).alias("called_r_truth_s"), n(~right & (F.col("predicted") == "S")).alias("called_s_truth_r"),
        n(F.col("abstained") == NO_DETERMINANTS).alias("no_determinants"), n(F.col("abstained") == INCOMPLETE).alias("incomplete"),
    )
    counts = determinants.groupBy("drug").agg(F.count_distinct("label").alias("n_determinants"))
    out = out.join(counts.hint("merge"), "drug", "left").withColumn("n_determinants", F.coalesce("n_determinants", F.lit(0)))
    estimable = F.col("n_answered") >= min_answered
    return out.withColumns({
        "coverage": F.col("n_answered") / F.col("n_isolates"), "error_rate": F.when(estimable, F.col("n_errors") / F.col("n_answered")).otherwise(0.0), "estimable": estimable,
    })


def needed(measured: DataFrame, min_resistant: int = 10) -> DataFrame:
    """Per drug: about how many more isolates would make it estimable, from prevalence and answers seen; null where that says nothing."""
    n = F.col("n_isolates")
    total = min_resistant / (F.col("n_resistant_truth") / n) / (F.col("n_answered") / n)
    known = ~F.col("estimable") & (n > 0) & (F.col("n_resistant_truth") > 0) & (F.col("n_answered") > 0)
    return measured.select("drug", "n_isolates", "estimable", F.when(known, F.greatest(F.lit(0), F.floor(total) - n)).cast("long").alias("isolates_needed"))


def measurability(drugs: DataFrame, catalogued: DataFrame, phenotyped: DataFrame) -> DataFrame:
    """Per drug of interest: which of catalogue and phenotype source knows it, and which side is missing."""
    lower = lambda df, name: df.select(F.lower("drug").alias("_drug")).distinct().withColumn(name, F.lit(True))
    out = drugs.select("drug", F.lower("drug").alias("_drug")).distinct().join(lower(catalogued, "_c").hint("merge"), "_drug", "left").join(lower(phenotyped, "_p").hint("merge"), "_drug", "left")
    c, p = F.col("_c").isNotNull(), F.col("_p").isNotNull()
    missing = F.when(c & p, "").when(c, "phenotype").when(p, "catalogue").otherwise("both")
    return out.select("drug", c.alias("in_catalogue"), p.alias("in_phenotype_source"), (c & p).alias("measurable"), missing.alias("missing_side"))


def lineage_rows(rates: DataFrame) -> DataFrame:
    """Rows per (drug, lineage) of a drug that has any typed lineage; ``rates`` has lineage ``all`` for the pooled row."""
    typed = rates.where("lineage NOT IN ('all', 'unknown')").select("drug").distinct()
    return rates.where("lineage <> 'all'").join(typed.hint("merge"), "drug", "left_semi")


def report_rows(measured: DataFrame, rates: DataFrame) -> DataFrame:
    """Report row per drug: the baseline beside pooled rates, numbers hidden where they are not estimable."""
    pooled = rates.where("lineage = 'all'").select("drug", "sensitivity", "specificity", "vme_rate", "me_rate", "call_rate")
    out = measured.join(pooled.hint("merge"), "drug", "left")
    shown = lambda c: F.when(F.col("estimable"), F.col(c)).alias(c)
    return out.select("drug", "n_isolates", "n_answered", "n_determinants", "estimable", "coverage", *[shown(c) for c in ("error_rate", "sensitivity", "specificity", "vme_rate", "me_rate")])


def strata_matrix(rates: DataFrame, lineages: list[str]) -> DataFrame:
    """One row per drug, one column per lineage: the mean of both error rates that are known."""
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    n = F.col("vme_rate").isNotNull().cast("int") + F.col("me_rate").isNotNull().cast("int")
    cell = F.when(n > 0, (known("vme_rate") + known("me_rate")) / n)
    return rates.where("lineage <> 'all'").withColumn("_cell", cell).groupBy("drug").pivot("lineage", lineages).agg(F.max("_cell"))
