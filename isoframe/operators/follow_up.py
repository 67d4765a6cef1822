"""What to look at next: signals, attached claims, context of conflicts, and plans within a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the probability from which a calibrated model moves a variant up.
PRIORITY_PROBABILITY = 0.5


def priority_signals(predicted: DataFrame, calibrations: DataFrame, least: float = PRIORITY_PROBABILITY) -> DataFrame:
    """Rows (variant, drug, p) that a calibrated, usable model moves up; others have no row and none moves down.

    ``calibrations`` has drug, ece and refused (null: calibrated).
    """
    usable = calibrations.where("refused IS NULL AND ece IS NOT NULL").select("drug", "ece")
    return predicted.where(F.col("p") >= least).join(usable.hint("merge"), "drug")


def mic_panel(rows: DataFrame, drugs: list[str], order: str, accepted: tuple[str, ...] = ("HIGH",)) -> DataFrame:
    """Evaluable rows of the wanted drugs and accepted quality, the last by ``order`` of each (isolate, drug)."""
    good = rows.where(F.col("drug").isin(drugs) & F.col("evaluable") & F.coalesce(F.upper("quality").isin(*accepted), F.lit(False)))
    last = Window.partitionBy("isolate_id", "drug").orderBy(F.col(order).desc(), "mic")
    return good.withColumn("_k", F.row_number().over(last)).where("_k = 1").select("isolate_id", "drug", "mic")


def attached_claims(queue: DataFrame, claims: DataFrame) -> DataFrame:
    """Queue rows (variant, drug) with the claims about their variant side by side, contradictory ones too; they change no rank.

    ``claims`` has variant, source and effect.
    """
    said = claims.groupBy("variant").agg(
        F.count("*").alias("n_claims"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", "source", "effect"))), "; ").alias("claims"), (F.count_distinct("effect") > 1).alias("contradictory")
    )
    return queue.join(said.hint("merge"), "variant", "left").na.fill(0, ["n_claims"]).na.fill("", ["claims"]).na.fill(False, ["contradictory"])


def matched_predictions(predicted: DataFrame, queue: DataFrame, scopes: DataFrame) -> DataFrame:
    """Add violation: repeated, model not approved for the drug (and lineage or unknown), or no such (variant, drug) in the queue; null where it may be shown.

    ``predicted`` has variant, drug, model and lineage, ``scopes`` (model, drug, lineage).
    """
    times = F.count("*").over(Window.partitionBy("variant", "drug", "model"))
    approved = scopes.select("model", "drug", F.col("lineage").alias("_l")).distinct().withColumn("_ok", F.lit(True))
    known = predicted.withColumn("_times", times).withColumn("_l", F.coalesce("lineage", F.lit("unknown")))
    out = known.join(approved.hint("merge"), ["model", "drug", "_l"], "left").join(queue.select("variant", "drug").distinct().withColumn("_queued", F.lit(True)).hint("merge"), ["variant", "drug"], "left")
    reason = F.when(F.col("_times") > 1, "repeated").when(F.col("_ok").isNull(), "not approved").when(F.col("_queued").isNull(), "not queued")
    return out.select(*predicted.columns, reason.alias("violation"))


def conflict_context(conflicts: DataFrame, lines: DataFrame, most: int = 6) -> DataFrame:
    """Conflicts (drug) with up to ``most`` lines (drug, place, line) in order of place, then how many were left out."""
    order = Window.partitionBy("drug").orderBy("place", "line")
    ranked = lines.withColumn("_k", F.row_number().over(order))
    told = ranked.groupBy("drug").agg(F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.struct("_k", "line")))).alias("_lines"), F.count("*").alias("_n"))
    shown = F.transform("_lines", lambda x: x["line"])
    over = F.when(F.col("_n") > most, F.array(F.concat(F.lit("and "), (F.col("_n") - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return conflicts.join(told.select("drug", F.array_join(F.concat(shown, over), "; ").alias("context")).hint("merge"), "drug", "left").withColumn("context", F.coalesce("context", F.lit("")))


def context_errors(rows: DataFrame) -> DataFrame:
    """Report rows whose counts may not be: negative, or more resistant than tested; ``rows`` has row, total and resistant."""
    reason = F.when((F.col("total") < 0) | (F.col("resistant") < 0), "negative").when(F.col("resistant") > F.col("total"), "resistant above tested")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("row", "reason")


#: Fixed: categories, how sure they are, their priority and what may be done.
FINDINGS = {
    "mic_prediction_disagreement": ("observed", 1, "review_phenotype,confirm_phenotype"),
    "analytical_failure": ("observed", 0, "review_sample_and_qc"),
    "mic_category_mismatch": ("observed", 0, "review_phenotype"),
    "phenotype_discordance": ("observed", 0, "review_phenotype,confirm_phenotype"),
    "engine_discordance": ("observed", 0, "review_engine_evidence"),
    "catalogue_drift": ("possible", 1, "replay_catalogues"),
    "coverage_gap": ("observed", 1, "review_coverage,repeat_sequencing"),
    "historical_association": ("observed", 2, "review_association,confirm_phenotype"),
    "uncertain_interpretation": ("observed", 2, "review_variant,confirm_phenotype"),
    "validation_gap": ("observed", 2, "review_validation_scope"),
    "ntm_induction_context": ("observed", 1, "review_ntm_context,assess_inducible_resistance"),
}


def investigated(results: DataFrame, evidence: DataFrame, qc: DataFrame, predictions: DataFrame, induction: tuple[str, str]) -> DataFrame:
    """What is unresolved about each sample and drug: sample_id, finding (id), drug, category, certainty, priority, actions, detail and n_evidence.

    ``results`` has sample_id, drug, call, genomic_call, phenotypic_call, discordant, assay_status
    and organism; ``evidence`` sample_id, drug, tier, call, scope, comparison (what a measured
    value says), result (what the laboratory says) and version; ``qc`` sample_id, qc_check and
    status; ``predictions`` sample_id, drug and conflict. ``induction`` names the organism and
    drug whose early susceptible results settle nothing.

    Evidence is aggregated per (sample, drug) before it meets the results; each rule is
    one condition on a row, and a row gives as many findings as conditions hold. Failed
    checks of a sample are one finding of drug ``*``. Null flags count as false.
    """
    is_ = lambda c: F.coalesce(c, F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    measured, old = F.col("tier") == "phenotypic", F.coalesce(F.col("scope"), F.lit("")) == "historical"
    open_ = (F.col("call") == "indeterminate") & ~old & ~is_(measured)
    version = F.nullif(F.col("version"), F.lit("unknown"))
    facts = evidence.groupBy("sample_id", "drug").agg(
        F.count("*").alias("_n"), count(measured).alias("_measured"), count(measured & F.col("comparison").isNotNull() & ~F.col("comparison").eqNullSafe(F.col("result"))).alias("_apart"),
        F.count_distinct(version).alias("_versions"), count(old).alias("_old"), count(open_).alias("_open"),
    )
    rows = results.join(facts.hint("merge"), ["sample_id", "drug"], "left").na.fill(0, ["_n", "_measured", "_apart", "_versions", "_old", "_open"])
    discordant, measured_too = is_(F.col("discordant")), F.col("_measured") > 0
    conditions = {
        "mic_category_mismatch": F.col("_apart") > 0, "phenotype_discordance": discordant & measured_too, "engine_discordance": discordant & ~measured_too, "catalogue_drift": discordant & ~measured_too & (F.col("_versions") > 1),
        "coverage_gap": is_(F.col("assay_status") == "insufficient") & F.col("phenotypic_call").isNull(), "historical_association": F.col("_old") > 0, "uncertain_interpretation": F.col("_open") > 0,
        "validation_gap": is_(F.col("genomic_call") == "indeterminate") & (F.col("_open") == 0) & ~discordant,
        "ntm_induction_context": is_(F.col("organism") == induction[0]) & (F.col("drug") == induction[1]) & ~is_(F.col("call").isin("resistant", "susceptible")),
    }
    held = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))
    found = rows.select("sample_id", "drug", "_n", "_open", F.explode(held).alias("category"))
    n = F.when(F.col("category") == "uncertain_interpretation", F.col("_open")).otherwise(F.col("_n"))
    found = found.select("sample_id", "drug", "category", F.lit(None).cast("string").alias("detail"), n.alias("n_evidence"))
    none = F.lit(0).cast("long").alias("n_evidence")
    failed = qc.where("status = 'fail' AND qc_check <> 'callable_mask'").groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_set("qc_check")), "; ").alias("detail"))
    found = found.unionByName(failed.select("sample_id", F.lit("*").alias("drug"), F.lit("analytical_failure").alias("category"), "detail", none))
    apart = predictions.where("conflict").select("sample_id", "drug").distinct()
    found = found.unionByName(apart.select("sample_id", "drug", F.lit("mic_prediction_disagreement").alias("category"), F.lit(None).cast("string").alias("detail"), none))
    told = F.create_map(*[x for name, (sure, priority, actions) in FINDINGS.items() for x in (F.lit(name), F.struct(F.lit(sure).alias("certainty"), F.lit(priority).alias("priority"), F.lit(actions).alias("actions")))])
    own = F.substring(F.sha2(F.concat_ws("|", F.col("sample_id").cast("string"), "drug", "category"), 256), 1, 24)
    return found.withColumn("_t", told[F.col("category")]).select("sample_id", own.alias("finding"), "drug", "category", "_t.*", "detail", "n_evidence")


def plans(findings: DataFrame, menu: DataFrame, budget: float | None = None) -> DataFrame:
    """One option per finding of a sample, by priority, within the sample's budget: option, status and charged.

    ``findings`` has sample_id, finding, drug, priority and action, ``menu`` option,
    action, available and cost. The cheapest available option is taken; one that the
    drug's plan has already is free; an unknown cost is never 0. Findings are sorted by
    sample and planned as they come; the menu (counted) has at most 1,000 options.
    """
    if menu.count() > 1_000:
        raise ValueError("a menu of at most 1,000 options is expected")
    options = [r.asDict() for r in menu.select("option", "action", "available", "cost").collect()]
    result = "sample_id long, finding string, status string, option string, charged double"

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample, left, chosen = None, budget, set()
        for table in batches:
            out = []
            for f in table.itertuples(index=False):
                if f.sample_id != sample:
                    sample, left, chosen = f.sample_id, budget, set()
                fits = [o for o in options if o["action"] == f.action]
                ready = sorted((o for o in fits if o["available"]), key=lambda o: ((f.drug, o["option"]) not in chosen, o["cost"] is None, o["cost"] or 0, o["option"]))
                pick = next((o for o in ready if left is None or (f.drug, o["option"]) in chosen or o["cost"] is not None and o["cost"] <= left), None)
                if pick is None:
                    priced = any(o["cost"] is not None for o in ready)
                    status, charged = ("deferred_budget" if priced else "cost_unknown") if ready else ("unavailable" if fits else "availability_unknown"), None
                else:
                    status, charged = "recommended", 0.0 if (f.drug, pick["option"]) in chosen else pick["cost"]
                    chosen.add((f.drug, pick["option"]))
                    left = left if left is None else left - (charged or 0.0)
                out.append([sample, f.finding, status, pick and pick["option"], charged])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in result.split(", ")])

    rows = findings.select("sample_id", "finding", "drug", "priority", "action")
    return rows.repartition("sample_id").sortWithinPartitions("sample_id", "priority", "drug", "finding").mapInPandas(plan, result)
