"""Rules on tables: violations, rejects with reasons, identities, and verified fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_GIVEN = "not_performed"


def violations(rows: DataFrame, key: str, rules: dict[str, Column], unique: tuple[str, ...] = ()) -> DataFrame:
    """(key, rule) for every rule a row breaks; ``rules`` are conditions that must hold (unknown is a breach).

    ``unique`` columns must be filled and not repeat; only their repeated values are joined.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    out = rows.select(F.col(key).alias("key"), F.explode(broken).alias("rule"))
    for c in unique:
        blank = F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
        twice = rows.where(~blank).groupBy(F.col(c).alias("_c")).agg(F.count("*").alias("_n")).where("_n > 1").select("_c")
        again = rows.join(twice.hint("merge"), F.col(c) == F.col("_c"))
        out = out.unionByName(again.select(F.col(key).alias("key"), F.lit(f"repeated {c}").alias("rule"))).unionByName(rows.where(blank).select(F.col(key).alias("key"), F.lit(f"missing {c}").alias("rule")))
    return out


def unfounded_resistance(evidence: DataFrame) -> DataFrame:
    """Evidence rows that call resistance without a phenotype or a graded entry; none is allowed."""
    return evidence.where((F.col("call") == "resistant") & ~F.coalesce(F.col("tier").isin("phenotypic", "catalogued"), F.lit(False)))


def screened_runs(runs: DataFrame, excluded: list[str]) -> DataFrame:
    """Add reject_reason: platform, layout, sample or organism, in that order; null for runs that are taken."""
    upper = lambda c: F.upper(F.coalesce(c, F.lit("")))
    barred = F.lit(False)
    for token in excluded:
        barred = barred | F.lower(F.coalesce("organism", F.lit(""))).contains(token.lower())
    reason = F.when(upper("platform") != "ILLUMINA", "platform").when(upper("layout") != "PAIRED", "layout").when(F.coalesce("biosample", F.lit("")) == "", "no sample").when(barred, "organism")
    return runs.withColumn("reject_reason", reason)


def benchmark_part(rows: DataFrame, outcome: str = "expected_outcome") -> DataFrame:
    """Add part: control for rows with a declared expected outcome, else benchmark."""
    return rows.withColumn("part", F.when(F.coalesce(F.trim(outcome), F.lit("")) != "", "control").otherwise("benchmark"))


def compared_fields(rows: DataFrame, verified: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and errors: fields that differ from the verified table (case and outer blanks aside), or that it lacks the row."""
    known = verified.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_known"))
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    joined = rows.join(known.hint("merge"), key, "left")
    wrong = F.array_join(F.array_compact(F.array(*[F.when(plain(c) != plain(f"_{c}"), F.lit(c)) for c in fields])), ",")
    return joined.select(key, F.when(F.col("_known").isNull(), "not found").otherwise(wrong).alias("errors"))


def identity_conflicts(attached: DataFrame, contexts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Attached rows (report) whose stated identity differs from their sample's; what is not stated does not conflict."""
    known = contexts.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    joined = attached.join(known.hint("merge"), key)
    differs = lambda c: F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c))
    wrong = F.array_compact(F.array(*[differs(c) for c in fields]))
    return joined.withColumn("field", F.explode(wrong)).select("report", key, "field")


def lab_evidence(observations: DataFrame) -> DataFrame:
    """Measured results as phenotypic evidence: quality not passed leaves them indeterminate, a measured value that disagrees is noted and the category kept.

    ``observations`` has result, quality and mic_call (the category of the measured value, null if it says nothing).
    """
    notes = F.array_compact(F.array(
        F.when(F.col("mic_call").isNotNull() & (F.col("mic_call") != F.col("result")), "value and category differ").when(F.col("mic").isNotNull() & F.col("mic_call").isNull(), "value says nothing"),
        F.when(F.col("quality") != "pass", "quality"),
    ))
    return observations.withColumn("call", F.when(F.col("quality") != "pass", "indeterminate").otherwise(F.col("result"))).withColumn("notes", F.array_join(notes, "; ")).withColumn("tier", F.lit("phenotypic"))


def qc_table(samples: DataFrame, supplied: DataFrame, controls: list[str]) -> DataFrame:
    """(isolate_id, qc_check, status) for every control of every sample: what was supplied, failures first, else not_performed."""
    rank = F.when(F.col("status") == "fail", 0).when(F.col("status") == "warn", 1).otherwise(2)
    worst = supplied.groupBy("isolate_id", "qc_check").agg(F.min_by("status", rank).alias("status"))
    every = samples.select("isolate_id", F.explode(F.lit(controls)).alias("qc_check"))
    return every.unionByName(worst.select("isolate_id", "qc_check")).distinct().join(worst.hint("merge"), ["isolate_id", "qc_check"], "left").withColumn("status", F.coalesce("status", F.lit(NOT_GIVEN)))


def status_counts(qc: DataFrame) -> DataFrame:
    """Checks per status, and whether that status blocks."""
    return qc.groupBy("status").agg(F.count("*").alias("n")).withColumn("blocking", F.col("status") == "fail")


def restricted(coverage: DataFrame, panel: DataFrame) -> DataFrame:
    """Coverage rows with ``kept``: whether the panel targets their locus; what it does not target is not trusted."""
    return coverage.join(panel.select("locus").distinct().withColumn("_in", F.lit(True)).hint("merge"), "locus", "left").withColumn("kept", F.col("_in").isNotNull()).drop("_in")


def unsupported(profile: DataFrame, panel: DataFrame) -> DataFrame:
    """Drugs with no declared locus or with loci that the panel lacks, and those loci."""
    marked = profile.join(panel.select("locus").distinct().withColumn("_in", F.lit(True)).hint("merge"), "locus", "left")
    out = marked.groupBy("drug").agg(F.count("locus").alias("n_loci"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_in").isNull(), F.col("locus")))), ",").alias("missing"))
    return out.where("missing <> '' OR n_loci = 0")


def evidence_ids(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add evidence_id: the hash of the columns in their fixed order, null and blank told apart."""
    parts = [F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(c).cast("string"))) for c in columns]
    return rows.withColumn("evidence_id", F.sha2(F.concat_ws("|", *parts), 256))
