"""Evidence of many sites: associations, disclosure control, dependence, discordance, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], arrival: str, latest: bool = False) -> DataFrame:
    """One row per key: the first by the arrival column (or the last); ties are broken by the other columns in order of name."""
    order = [F.col(arrival).desc() if latest else F.col(arrival).asc(), *[F.col(c) for c in sorted(df.columns) if c not in (*keys, arrival)]]
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def associations(obs: DataFrame) -> DataFrame:
    """Per (variant, drug): isolates counted once (first arrival wins), R and S, sites, lineages, cohort totals.

    ``obs`` is long: one row per (arrival, isolate, drug, variant), with a null variant
    where an isolate has none. Cohort totals count every isolate with a phenotype for
    the drug, those without a variant too; untyped lineages are one lineage, unknown.
    """
    known = obs.where(F.col("phenotype").isin("R", "S")).withColumn("lineage", F.coalesce("lineage", F.lit("unknown")))
    one = known.where("variant IS NOT NULL").groupBy("variant", "drug", "isolate_id").agg(F.min_by(F.struct("phenotype", "site_id", "lineage"), F.struct("arrival", "phenotype")).alias("_o"))
    counts = one.groupBy("variant", "drug").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("_o.phenotype") == "R", 1)).alias("n_r"), F.count(F.when(F.col("_o.phenotype") == "S", 1)).alias("n_s"),
        F.count_distinct("_o.site_id").alias("n_sites"), F.count_distinct("_o.lineage").alias("n_lineages"),
    )
    per_isolate = known.groupBy("drug", "isolate_id").agg(F.min_by("phenotype", F.struct("arrival", "phenotype")).alias("_p"))
    cohort = per_isolate.groupBy("drug").agg(F.count(F.when(F.col("_p") == "R", 1)).alias("cohort_r"), F.count(F.when(F.col("_p") == "S", 1)).alias("cohort_s"))
    return counts.join(cohort, "drug").withColumn("r_fraction", F.col("n_r") / F.col("n"))


def gates(assoc: DataFrame, min_n: int = 50, min_fraction: float = 0.8, min_sites: int = 3, min_s: int = 10, min_lineages: int = 2) -> DataFrame:
    """All gates that an association fails, and whether it may be proposed."""
    failed = F.array_compact(F.array(
        F.when(F.col("n") < min_n, "isolates"), F.when(F.col("r_fraction") < min_fraction, "fraction"), F.when(F.col("n_sites") < min_sites, "sites"),
        F.when(F.col("cohort_s") < min_s, "susceptible cohort"), F.when(F.col("cohort_s") - F.col("n_s") <= 0, "controls"), F.when(F.col("n_lineages") < min_lineages, "lineages"),
    ))
    return assoc.withColumns({"eligible": F.size(failed) == 0, "failed": F.array_join(failed, ",")})


def small_cells(obs: DataFrame, min_isolates: int = 5, min_sites: int = 2) -> DataFrame:
    """(variant, drug) cells with too few isolates or sites to be disclosed."""
    cells = obs.where("variant IS NOT NULL").groupBy("variant", "drug").agg(F.count_distinct("isolate_id").alias("n_isolates"), F.count_distinct("site_id").alias("n_sites"))
    return cells.where((F.col("n_isolates") < min_isolates) | (F.col("n_sites") < min_sites))


def suppressed(obs: DataFrame, min_isolates: int = 5) -> DataFrame:
    """Rows (arrival, drug) with the variants left after rare cells are dropped; empty rows go."""
    cells = obs.where("variant IS NOT NULL").groupBy("variant", "drug").agg(F.count_distinct("isolate_id").alias("_n"))
    kept = obs.join(cells.where(F.col("_n") >= min_isolates).select("variant", "drug"), ["variant", "drug"], "left_semi")
    return kept.groupBy("arrival", "drug").agg(F.count_distinct("variant").alias("n_kept"), F.min("variant").alias("first_variant"), F.max("variant").alias("last_variant"))


def dependence(df: DataFrame, group: str, by: list[str]) -> DataFrame:
    """Groups per key, share of the largest, and the effective number (inverse Simpson)."""
    counts = df.where(F.col(group).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("_n"))
    out = counts.groupBy(*by).agg(F.count("*").alias("n_groups"), F.sum("_n").alias("n"), F.max("_n").alias("_most"), F.sum(F.col("_n") * F.col("_n")).alias("_squares"))
    n = F.col("n").cast("double")
    return out.select(*by, "n_groups", "n", (F.col("_most") / n).alias("largest_share"), (n * n / F.col("_squares")).alias("effective_n"))


def summary(df: DataFrame, columns: list[str], value: str) -> DataFrame:
    """Counts and sums of each value of each column, and of all rows, in one pass of grouping sets."""
    out = df.groupingSets([[], *[[c] for c in columns]], *columns).agg(F.count("*").alias("n"), F.sum(value).alias("total"), *[F.grouping(c).alias(f"_g_{c}") for c in columns])
    dimension, item = F.lit("all"), F.lit(None).cast("string")
    for c in columns:
        dimension = F.when(F.col(f"_g_{c}") == 0, c).otherwise(dimension)
        item = F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(item)
    return out.select(dimension.alias("dimension"), item.alias("item"), "n", "total")


def discordance(calls: DataFrame) -> DataFrame:
    """(variant, drug) pairs that sites call differently, and whether versions explain it.

    Any unknown version makes the pair unknown; disjoint version sets of two calls are
    version-explained, overlapping ones rule-explained.
    """
    per = calls.groupBy("variant", "drug", "call").agg(
        F.max(F.when(F.col("version").isNull(), 1).otherwise(0)).alias("_unknown"), F.collect_set("version").alias("_versions")
    )
    whole = per.groupBy("variant", "drug").agg(F.count("*").alias("n_calls"), F.max("_unknown").alias("_unknown"), F.collect_list("_versions").alias("_sets"))
    pairs = F.flatten(F.transform("_sets", lambda x, i: F.transform(F.slice("_sets", i + 2, F.size("_sets")), lambda y: F.arrays_overlap(x, y))))
    kind = F.when(F.col("_unknown") == 1, "unknown").when(F.exists(pairs, lambda x: ~x), "version-explained").otherwise("rule-explained")
    return whole.where("n_calls > 1").select("variant", "drug", "n_calls", kind.alias("kind"))


def drift(points: DataFrame, by: list[str], baseline: float, tolerance: float, min_points: int = 5) -> DataFrame:
    """Mean of a measure per key and whether it fell from the baseline; not assessed with few points."""
    out = points.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    state = F.when(F.col("n") < min_points, "not_assessed").when(baseline - F.col("mean") >= tolerance, "alarm").otherwise("stable")
    return out.withColumn("state", state)


def calibration_error(df: DataFrame, by: list[str], bins: int = 5, min_n: int = 30, min_class: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of probability; refused for few rows or a rare class."""
    rows = df.where("p IS NOT NULL AND truth IS NOT NULL").withColumn("_bin", F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)))
    per = rows.groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.sum("p").alias("_p"), F.count(F.when(F.col("truth"), 1)).alias("_r"))
    out = per.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_r").alias("n_r"), F.sum(F.abs(F.col("_p") - F.col("_r"))).alias("_gap"))
    s = F.col("n") - F.col("n_r")
    reason = F.when(F.col("n") < min_n, "too few rows").when(F.col("n_r") < min_class, "too few resistant").when(s < min_class, "too few susceptible")
    return out.withColumn("refused", reason).withColumn("ece", F.when(reason.isNull(), F.col("_gap") / F.col("n"))).drop("_gap")


def promotion(obs: DataFrame, known: DataFrame, limits: dict[str, float], top: int = 5) -> DataFrame:
    """Associations with every gate they fail: size, fraction, sites, susceptible cohort, controls, lineages, co-occurrence.

    A lineage supports an association with ``min_lineage_n`` isolates at ``min_fraction``.
    Of the ``top`` variants seen most often beside it (in the observation that counts),
    a known determinant (``known``: variant) in ``max_cooccurrence`` of its resistant
    isolates blocks it.
    """
    usable = obs.where(F.col("phenotype").isin("R", "S")).withColumn("lineage", F.coalesce("lineage", F.lit("unknown")))
    one = usable.where("variant IS NOT NULL").groupBy("variant", "drug", "isolate_id").agg(F.min(F.struct("arrival", "phenotype", "site_id", "lineage")).alias("o")).select("variant", "drug", "isolate_id", "o.*")
    per = one.groupBy("variant", "drug", "lineage").agg(F.count("*").alias("_n"), F.count(F.when(F.col("phenotype") == "R", 1)).alias("_r"))
    holds = (F.col("_n") >= limits["min_lineage_n"]) & (F.col("_r") >= limits["min_fraction"] * F.col("_n"))
    lineages = per.groupBy("variant", "drug").agg(F.count(F.when(holds, 1)).alias("n_lineages"))
    sums = one.groupBy("variant", "drug").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("phenotype") == "R", 1)).alias("n_r"), F.count(F.when(F.col("phenotype") == "S", 1)).alias("n_s"), F.count_distinct("site_id").alias("n_sites")
    )
    isolates = usable.groupBy("drug", "isolate_id").agg(F.min(F.struct("arrival", "phenotype")).alias("o"))
    cohort = isolates.groupBy("drug").agg(F.count("*").alias("_cohort"), F.count(F.when(F.col("o.phenotype") == "S", 1)).alias("cohort_s"))
    beside = usable.where("variant IS NOT NULL").select("arrival", "isolate_id", "drug", F.col("variant").alias("other")).distinct()
    pairs = one.select("variant", "drug", "isolate_id", "arrival").join(beside.hint("merge"), ["arrival", "isolate_id", "drug"]).where("variant <> other").groupBy("variant", "drug", "other").agg(F.count("*").alias("_c"))
    most = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("variant", "drug").orderBy(F.col("_c").desc(), "other"))).where(F.col("_k") <= top)
    marked = most.join(known.select(F.col("variant").alias("other")).distinct().hint("merge"), "other").join(sums.select("variant", "drug", "n_r").hint("merge"), ["variant", "drug"])
    blocked = marked.where((F.col("n_r") > 0) & (F.col("_c") >= limits["max_cooccurrence"] * F.col("n_r"))).select("variant", "drug", F.lit(True).alias("_blocked")).distinct()
    out = sums.join(lineages.hint("merge"), ["variant", "drug"]).join(cohort.hint("merge"), "drug").join(blocked.hint("merge"), ["variant", "drug"], "left").withColumn("r_fraction", F.col("n_r") / F.col("n"))
    failed = F.array_compact(F.array(
        F.when(F.col("n") < limits["min_n"], "isolates"), F.when(F.col("r_fraction") < limits["min_fraction"], "fraction"), F.when(F.col("n_sites") < limits["min_sites"], "sites"), F.when(F.col("cohort_s") < limits["min_s"], "susceptible cohort"),
        F.when(F.col("_cohort") - F.col("n") <= 0, "controls"), F.when(F.col("n_lineages") < limits["min_lineages"], "lineages"), F.when(F.col("_blocked"), "co-occurrence"),
    ))
    return out.select("variant", "drug", "n", "n_r", "n_s", "n_sites", "n_lineages", "cohort_s", "r_fraction", (F.size(failed) == 0).alias("eligible"), F.array_join(failed, ",").alias("failed"))


def provisional(candidates: DataFrame, approved: DataFrame) -> DataFrame:
    """Catalogue rows of approved candidates (variant, drug); one that is not eligible gives none."""
    taken = candidates.where("eligible").join(approved.distinct().hint("merge"), ["variant", "drug"], "left_semi")
    return taken.select("variant", "drug", F.lit("resistant").alias("call"), F.round("r_fraction", 3).alias("confidence"), "n", "n_sites")
