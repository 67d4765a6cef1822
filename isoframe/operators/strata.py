"""Strata of isolates by resistance background, lineage and site, and carriers within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.operators.joins import null_safe, sized


def background(isolates: DataFrame, carriage: DataFrame, determinants: DataFrame) -> DataFrame:
    """Background key of each (isolate, drug): the sorted determinants it carries, empty if none.

    ``determinants`` (drug, label) is the catalogue's resistant part.
    """
    carried = carriage.join(sized(determinants), "label").groupBy("isolate_id", "drug").agg(F.array_join(F.sort_array(F.collect_set("label")), "+").alias("background"))
    drugs = [r.drug for r in determinants.select("drug").distinct().limit(10_001).collect()]
    if len(drugs) > 10_000:
        raise ValueError("determinants of more than 10,000 drugs are not expected")
    everyone = isolates.withColumn("drug", F.explode(F.lit(drugs)))
    return everyone.join(carried.hint("merge"), ["isolate_id", "drug"], "left").withColumn("background", F.coalesce("background", F.lit("")))


def carriers(placed: DataFrame, carriage: DataFrame, candidates: DataFrame, determinants: DataFrame, unassessed: DataFrame | None = None) -> DataFrame:
    """Carriers and others of each candidate in each stratum that holds a carrier.

    A candidate that is a determinant of the drug does not count in its carriers'
    background. Isolates that ``unassessed`` (isolate_id, label) names for a candidate
    are none of its others, unless they carry it; without it all isolates are assessed.

    Strata are counted once; candidates touch only their carriers and the not-assessed,
    so the cost follows those and not candidates times isolates.
    """
    keys = ["drug", "background", "lineage", "site_id"]
    candidates = sized(candidates.select("label").distinct())
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("_n"))
    carried = carriage.join(candidates, "label", "left_semi").select("isolate_id", "label").distinct()
    own = sized(determinants.select("drug", "label").distinct())
    rest = carriage.join(own, "label").select("isolate_id", "drug", F.col("label").alias("_other"))
    themselves = carried.join(own, "label").join(rest.hint("merge"), ["isolate_id", "drug"]).groupBy("isolate_id", "drug", "label").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("_other") != F.col("label"), F.col("_other")))), "+").alias("_without")
    )
    held = placed.join(carried.hint("merge"), "isolate_id").join(sized(themselves), ["isolate_id", "drug", "label"], "left")
    held = held.withColumn("_own", F.col("_without").isNotNull()).withColumn("background", F.coalesce("_without", "background"))
    held = held.groupBy("label", *keys).agg(F.count("*").alias("n_carriers"), F.bool_or("_own").alias("_own"))

    # Carriers of a determinant are not in the stratum of the key without it.
    others = F.coalesce("_n", F.lit(0)) - F.when(F.col("_own"), 0).otherwise(F.col("n_carriers"))
    out = null_safe(held, sizes, keys).select("label", *keys, "n_carriers", others.alias("n_others"))
    if unassessed is None:
        return out
    missing = unassessed.select("isolate_id", "label").distinct().join(carried, ["isolate_id", "label"], "left_anti").join(candidates, "label", "left_semi")
    missing = placed.join(missing.hint("merge"), "isolate_id").groupBy("label", *keys).agg(F.count("*").alias("_missing"))
    left = (F.col("n_others") - F.coalesce("_missing", F.lit(0))).alias("n_others")
    return null_safe(out, missing, ["label", *keys]).select("label", *keys, "n_carriers", left)


def cooccurrence(carriage: DataFrame, candidates: DataFrame, determinants: DataFrame) -> DataFrame:
    """Share of a candidate's carriers that also carry each determinant."""
    mine = carriage.join(sized(candidates.select("label").distinct()), "label", "left_semi").select("isolate_id", F.col("label").alias("candidate"))
    total = mine.groupBy("candidate").agg(F.count("*").alias("_n"))
    both = mine.join(carriage.join(sized(determinants.select("label").distinct()), "label", "left_semi").hint("merge"), "isolate_id").where("candidate <> label")
    return both.groupBy("candidate", "label").agg(F.count("*").alias("n_both")).join(total, "candidate").withColumn("fraction", F.col("n_both") / F.col("_n")).drop("_n")
