"""Cohort views behind reports, workflow evaluation, external models and estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoframe.functions.display import given, readable, shown, variant_name
from isoframe.operators import accuracy, selective
from isoframe.operators.joins import rewritten


def phenotype_summary(rows: DataFrame) -> DataFrame:
    """Evaluable rows, R and S per drug."""
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("drug").agg(F.count("*").alias("n"), n(F.col("evaluable")).alias("n_evaluable"), n(F.col("evaluable") & (F.upper("phenotype") == "R")).alias("n_r"), n(F.col("evaluable") & (F.upper("phenotype") == "S")).alias("n_s"))


def workflow_arms(rows: DataFrame, strata: list[str]) -> DataFrame:
    """Per arm, over all rows and per value of each stratum in one pass: counts, rates among calls and among all, with abstentions kept.

    ``rows`` has truth (resistant or susceptible), baseline_call and intervention_call.
    """
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"{a}_call").alias("call")) for a in ("baseline", "intervention")]))
    long = rows.select(arms.alias("_a"), "truth", *[F.coalesce(F.col(s).cast("string"), F.lit("unknown")).alias(s) for s in strata]).select("_a.*", "truth", *strata)
    sets = long.groupingSets([["arm"], *[["arm", s] for s in strata]], "arm", *strata)
    r, called = F.col("truth") == "resistant", F.coalesce(F.col("call").isin("resistant", "susceptible"), F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    out = sets.agg(
        F.count("*").alias("n"), n(called).alias("n_called"), n(called & r & (F.col("call") == "resistant")).alias("tp"), n(called & ~r & (F.col("call") == "resistant")).alias("fp"), n(called & ~r & (F.col("call") == "susceptible")).alias("tn"),
        n(called & r & (F.col("call") == "susceptible")).alias("fn"), n(~called & r).alias("abstained_r"), n(~called & ~r).alias("abstained_s"), *[F.grouping(s).alias(f"_g_{s}") for s in strata],
    )
    stratum, value = F.lit("all"), F.lit(None).cast("string")
    for s in strata:
        stratum, value = F.when(F.col(f"_g_{s}") == 0, s).otherwise(stratum), F.when(F.col(f"_g_{s}") == 0, F.col(s)).otherwise(value)
    rate = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.select(
        "arm", stratum.alias("stratum"), value.alias("value"), "n", "n_called", "tp", "fp", "tn", "fn", "abstained_r", "abstained_s", rate(F.col("n_called"), F.col("n")).alias("call_rate"), rate(tp, tp + fn).alias("conditional_sensitivity"),
        rate(tn, tn + fp).alias("conditional_specificity"), rate(tp, tp + fn + F.col("abstained_r")).alias("resistant_yield"), rate(tn, tn + fp + F.col("abstained_s")).alias("susceptible_yield"),
    )


def paired_correctness(rows: DataFrame) -> DataFrame:
    """Rows improved, worsened and unchanged from baseline to intervention."""
    before, after = (F.coalesce(F.col(c) == F.col("truth"), F.lit(False)) for c in ("baseline_call", "intervention_call"))
    return rows.select(F.when(after & ~before, "improved").when(before & ~after, "worsened").otherwise("unchanged").alias("change")).groupBy("change").agg(F.count("*").alias("n"))


def storage_estimate(samples: DataFrame, present: DataFrame, factors: tuple[float, float, float]) -> DataFrame:
    """One row: samples present and pending, those of unknown size, and low, middle and high bytes of the rest."""
    joined = samples.join(present.select("sample_id").distinct().withColumn("_p", F.lit(True)).hint("merge"), "sample_id", "left")
    pending = F.col("_p").isNull()
    known = F.sum(F.when(pending, F.col("bases")))
    sizes = [F.round(known * f).cast("long").alias(n) for f, n in zip(factors, ("bytes_low", "bytes_mid", "bytes_high"), strict=True)]
    return joined.agg(F.count(F.when(~pending, 1)).alias("n_present"), F.count(F.when(pending, 1)).alias("n_pending"), F.count(F.when(pending & F.col("bases").isNull(), 1)).alias("n_unknown"), *sizes)


def discovery_summary(runs: DataFrame) -> DataFrame:
    """Runs by reject reason, null for those taken, with their distinct organisms."""
    return runs.groupBy("reject_reason").agg(F.count("*").alias("n"), F.count_distinct("organism").alias("n_organisms"))


def signal_gate(signals: DataFrame, min_isolates: int = 20, min_sites: int = 2, min_unexplained: int = 5) -> DataFrame:
    """Per drug: whether a cohort signal may be looked into, every reason why not, and its convergent genes.

    ``signals`` has drug, isolate_id, site_id, resistant, explained and gene (of an
    unexplained change, may be null). A gene is convergent with two isolates or more.
    """
    genes = signals.where("resistant AND NOT explained AND gene IS NOT NULL").groupBy("drug", "gene").agg(F.count_distinct("isolate_id").alias("_n")).where("_n >= 2")
    genes = genes.groupBy("drug").agg(F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("genes"))
    out = signals.groupBy("drug").agg(
        F.count_distinct("isolate_id").alias("n_isolates"), F.count_distinct("site_id").alias("n_sites"), F.count_distinct(F.when(F.col("resistant") & ~F.col("explained"), F.col("isolate_id"))).alias("n_unexplained")
    ).join(genes.hint("merge"), "drug", "left").withColumn("genes", F.coalesce("genes", F.lit("")))
    reasons = F.array_compact(F.array(
        F.when(F.col("n_isolates") < min_isolates, "isolates"), F.when(F.col("n_sites") < min_sites, "sites"), F.when(F.col("n_unexplained") < min_unexplained, "unexplained"), F.when(F.col("genes") == "", "no convergent gene"),
    ))
    return out.withColumn("reasons", F.array_join(reasons, ",")).withColumn("passes", F.col("reasons") == "")


def subtractive(targets: DataFrame) -> DataFrame:
    """Add passes: essential and without a human counterpart; unknown where the known parts do not decide."""
    return targets.withColumn("passes", F.col("essential") & ~F.col("human_homolog"))


def external_benchmark(predictions: DataFrame, truths: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per drug: predictions joined with truths, dropped ones, coverage, error, risk at the baseline's coverage and the verdict.

    ``predictions`` has isolate_id, drug, predicted (null: abstained) and confidence;
    ``truths`` isolate_id, drug, truth; ``baselines`` drug, base_coverage, base_risk.
    """
    joined = predictions.join(truths.hint("merge"), ["isolate_id", "drug"], "left")
    n = lambda c: F.count(F.when(c, 1))
    known = F.col("truth").isNotNull()
    answered = known & F.col("predicted").isNotNull()
    counts = joined.groupBy("drug").agg(n(known).alias("n_joined"), n(~known).alias("n_dropped"), n(answered).alias("n_answered"), n(answered & (F.col("predicted") != F.col("truth"))).alias("n_errors"))
    compared = selective.against_baseline(selective.curve(joined.where(known).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))), baselines)
    out = counts.join(compared.select("drug", "base_coverage", "base_risk", F.col("coverage").alias("matched_coverage"), F.col("risk").alias("matched_risk"), "verdict").hint("merge"), "drug", "left")
    return out.withColumns({"coverage": F.try_divide(F.col("n_answered").cast("double"), F.col("n_joined")), "error_rate": F.when(F.col("n_answered") >= 10, F.col("n_errors") / F.col("n_answered"))})


def registry_readiness(benchmark: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows of ``external_benchmark`` with ready, exclusion (why a registry may not have the scope) and the coverage and error it would be given.

    ``rates`` has drug, sensitivity and specificity. Rates are those at the matched point,
    where the verdict was decided; a scope is ready only with a risk there and with both
    rates. A drug without rates counts as not estimable.
    """
    out = benchmark.join(rates.select("drug", "sensitivity", "specificity").hint("merge"), "drug", "left")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in ("sensitivity", "specificity")]))
    reason = F.when(F.col("matched_risk").isNull(), F.concat(F.lit("no risk at the baseline's coverage: "), F.coalesce("verdict", F.lit("no baseline")))).when(F.size(missing) > 0, F.concat(F.array_join(missing, " and "), F.lit(" not estimable")))
    matched = F.col("matched_risk").isNotNull()
    return out.select(
        "drug", "sensitivity", "specificity", F.when(matched, F.col("matched_coverage")).otherwise(F.col("coverage")).alias("call_rate"), F.when(matched, F.col("matched_risk")).otherwise(F.col("error_rate")).alias("error_rate"),
        reason.alias("exclusion"), reason.isNull().alias("ready"),
    )


def prediction_errors(rows: DataFrame) -> DataFrame:
    """Rows of a prediction table that may not be loaded: missing keys, unknown values, confidence outside 0..1, repeated (isolate, drug)."""
    value = F.lower(F.trim(F.coalesce("predicted", F.lit(""))))
    error = (
        F.when(F.col("isolate_id").isNull() | (F.coalesce(F.trim("drug"), F.lit("")) == ""), "missing key").when(~value.isin("r", "s", "resistant", "susceptible", "", "abstain", "indeterminate"), "unknown value")
        .when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence outside 0..1")
    )
    again = rows.groupBy("isolate_id", F.lower(F.trim("drug")).alias("drug")).agg(F.count("*").alias("n")).where("n > 1").select("isolate_id", "drug", F.lit("repeated").alias("error"))
    return rows.withColumn("error", error).where("error IS NOT NULL").select("isolate_id", "drug", "error").unionByName(again)


def locus_matrix(coverage: DataFrame, loci: list[str]) -> DataFrame:
    """One row per sample, one column per locus: its callable fraction."""
    return coverage.groupBy("isolate_id").pivot("locus", loci).agg(F.max("callable_fraction"))


def discordant_rows(results: DataFrame) -> DataFrame:
    """Results whose two calls are both known and differ."""
    return results.where("genomic_call IS NOT NULL AND phenotypic_call IS NOT NULL AND genomic_call <> phenotypic_call")


def ranked_items(items: DataFrame) -> DataFrame:
    """Items of each sample in order of score (unscored last), numbered from 1."""
    order = Window.partitionBy("sample_id").orderBy(F.col("score").desc_nulls_last(), "variant", "drug")
    return items.withColumn("place", F.row_number().over(order))


def gene_positions(variants: DataFrame, n_samples: int) -> DataFrame:
    """Per (gene, pos) with a place: carriers and their share, upper-middle depth, mean fraction, and the attributes seen.

    The middle depth is found on counts of distinct depths.
    """
    rows = variants.where("gene IS NOT NULL AND pos IS NOT NULL")
    out = rows.groupBy("gene", "pos").agg(
        F.count_distinct("sample_id").alias("carriers"), F.avg("vaf").alias("mean_vaf"), F.array_join(F.array_sort(F.collect_set("consequence")), ",").alias("consequences"), F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions"),
    )
    depths = rows.where("depth IS NOT NULL").groupBy("gene", "pos", "depth").agg(F.count("*").alias("_n"))
    per = Window.partitionBy("gene", "pos")
    upto = F.sum("_n").over(per.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    middle = depths.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(per)).where("_upto > floor(_all / 2)").groupBy("gene", "pos").agg(F.min("depth").alias("median_depth"))
    return out.join(middle.hint("merge"), ["gene", "pos"], "left").withColumn("carrier_fraction", F.col("carriers") / n_samples)


def mutation_index(positions: DataFrame, queue: DataFrame) -> DataFrame:
    """Variants of positions and queue once by (gene, pos, ref, alt), places first."""
    both = positions.select("gene", "pos", "ref", "alt").unionByName(queue.select("gene", "pos", "ref", "alt"))
    return both.distinct().orderBy("gene", F.col("pos").asc_nulls_last(), "ref", "alt")


def sample_pages(results: DataFrame, coverage: DataFrame, evidence: DataFrame, contexts: DataFrame, page: int = 1000) -> DataFrame:
    """What is known about each sample: site, lineage, organism and assay, and its calls, variants and loci as arrays of structs.

    ``results`` has sample_id, drug, call and, optionally, tier and reason; ``coverage``
    sample_id, locus, callable_fraction, mean_depth; ``evidence`` sample_id, label, gene,
    drug, call, tier and, optionally, consequence; ``contexts`` sample_id and, optionally,
    site_id, lineage, organism, assay. A sample of any table has a row. Repeated rows are
    one item; a variant is its smallest row, a locus its most callable one; rows without
    sample, drug, label (or gene) or locus give no item. A context given twice is its smallest row.

    An array holds about ``page`` items: where a sample has more of a kind, its items are
    dealt to several rows (``page`` 0, 1, ...) by their hash, so none is lost and none grows with the data.
    """
    text = lambda df, default, *names: F.coalesce(given(df, *names), F.lit(default))
    held = lambda df, *names: rewritten(df.select(*[c for c in df.columns if c in ("sample_id", "drug", "call", *names)]), ["drug", "call"], readable)
    results, evidence = held(results.where("drug IS NOT NULL"), "tier", "reason"), held(evidence.where("label IS NOT NULL OR gene IS NOT NULL"), "label", "gene", "tier", "consequence")
    call = F.struct("drug", "call", text(results, "none", "tier").alias("tier"), text(results, "", "reason").alias("reason"))
    calls = results.select("sample_id", call.alias("call")).distinct()
    told = evidence.select("sample_id", F.coalesce("label", "gene").alias("_key"), F.struct(F.coalesce("gene", F.lit("Not supplied")).alias("gene"), variant_name(F.coalesce("label", "gene")).alias("variant"), shown(evidence, "Not supplied", "consequence").alias("consequence"), "drug", "call", "tier").alias("variant"))
    variants = told.groupBy("sample_id", "_key").agg(F.min("variant").alias("variant")).drop("_key")
    best = F.max(F.struct(F.col("callable_fraction").cast("double").alias("callable_fraction"), F.col("mean_depth").cast("double").alias("mean_depth")))
    loci = coverage.where("locus IS NOT NULL").groupBy("sample_id", "locus").agg(best.alias("_b")).select("sample_id", F.struct("locus", "_b.callable_fraction", "_b.mean_depth").alias("locus"))
    items = calls.unionByName(variants, allowMissingColumns=True).unionByName(loci, allowMissingColumns=True).where("sample_id IS NOT NULL")
    most = F.greatest(*[F.count(c) for c in ("call", "variant", "locus")])
    sizes = items.groupBy("sample_id").agg(F.ceil(most / page).alias("n_pages"))
    paged = items.join(sizes.hint("merge"), "sample_id").withColumn("page", F.pmod(F.xxhash64("call", "variant", "locus"), F.greatest(F.col("n_pages"), F.lit(1))))
    listed = lambda c: F.sort_array(F.collect_list(c))
    arrays = paged.groupBy("sample_id", "page").agg(listed("call").alias("calls"), listed("variant").alias("variants"), listed("locus").alias("loci"))
    fields = {"site": ("Not recorded", "site_id"), "lineage": ("Untyped", "lineage"), "organism": ("Not recorded", "organism"), "assay": ("Unknown", "assay")}
    one = contexts.where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.min(F.struct(*[given(contexts, name).alias(field) for field, (_, name) in fields.items()])).alias("_c"))
    out = arrays.join(one.hint("merge"), "sample_id", "outer")
    empty = lambda c: F.coalesce(c, F.array().cast(arrays.schema[c].dataType)).alias(c)
    return out.select("sample_id", F.coalesce("page", F.lit(0)).alias("page"), *[F.coalesce(F.col(f"_c.{field}"), F.lit(default)).alias(field) for field, (default, _) in fields.items()], *[empty(c) for c in ("calls", "variants", "loci")])


def sample_details(results: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row per sample: its calls as a sorted text and counts of its loci (``sample_pages`` has the rows themselves)."""
    calls = results.groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "drug", "call"))), ";").alias("calls"))
    loci = coverage.groupBy("sample_id").agg(F.count("*").alias("n_loci"), F.count(F.when(F.col("callable_fraction") >= 0.95, 1)).alias("n_callable"))
    return calls.join(loci.hint("merge"), "sample_id", "left")


def headline(drugs: DataFrame, results: DataFrame) -> DataFrame:
    """One row of figures; what has no data is null, never 0. ``drugs`` has drug, estimable, coverage and fn (very major errors)."""
    ok = F.col("estimable")
    n = F.count(F.when(ok, 1))
    covered = F.count(F.when(ok & F.col("coverage").isNotNull(), 1))
    ordered = F.array_sort(F.collect_list(F.when(ok, F.col("coverage"))))  # one number for each drug
    one = drugs.agg(F.count("*").alias("n_drugs"), n.alias("n_estimable"), F.when(n > 0, F.sum(F.when(ok, F.col("fn")))).alias("very_major_errors"), F.when(covered > 0, F.get(ordered, F.floor(covered / 2).cast("int"))).alias("median_coverage"))
    two = results.agg(F.count("*").alias("n_calls"), F.count(F.when(F.col("call") == "susceptible", 1)).alias("n_susceptible"), F.count(F.when(F.col("call") == "not_assessed", 1)).alias("n_not_assessed"))
    return one.crossJoin(F.broadcast(two))


def accuracy_table(rates: DataFrame, min_evaluable: int = 20) -> DataFrame:
    """Pooled rates per drug, hidden where too few rows are evaluable, in order of drug."""
    shown = lambda c: F.when(F.col("n_evaluable") >= min_evaluable, F.col(c)).alias(c)
    return rates.select("drug", "n_evaluable", (F.col("n_evaluable") >= min_evaluable).alias("estimable"), *[shown(c) for c in ("sensitivity", "specificity", "vme_rate", "me_rate", "call_rate")]).orderBy("drug")


def pooled_rates(calls: DataFrame) -> DataFrame:
    return accuracy.with_rates(accuracy.confusion(calls, ["drug"]))
