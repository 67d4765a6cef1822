"""Further evidence joined to results: calibrations, priors, rules on pairs, predictions, histories, tickets."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.operators.joins import classes, dealt, sized
from isoframe.operators.running import first_of_group

ESTABLISHED = ("resistant", "susceptible")


def calibrated(rows: DataFrame, calibrations: DataFrame, values: list[str]) -> DataFrame:
    """Rows (platform, drug, lineage) with the calibration of their lineage, else that of lineage ``*``."""
    own = calibrations.select("platform", "drug", "lineage", *[F.col(v).alias(f"_o_{v}") for v in values], F.lit(True).alias("_own"))
    wild = calibrations.where("lineage = '*'").select("platform", "drug", *[F.col(v).alias(f"_w_{v}") for v in values], F.lit(True).alias("_wild"))
    out = rows.join(own.hint("merge"), ["platform", "drug", "lineage"], "left").join(wild.hint("merge"), ["platform", "drug"], "left")
    pick = lambda v: F.when(F.col("_own"), F.col(f"_o_{v}")).otherwise(F.col(f"_w_{v}")).alias(v)
    return out.select(*rows.columns, *[pick(v) for v in values], F.when(F.col("_own"), "lineage").when(F.col("_wild"), "any").alias("basis"))


def priors(rows: DataFrame, associations: DataFrame, min_n: int = 10) -> DataFrame:
    """Rows (variant, drug) with prior: the resistant fraction of the association, null below ``min_n`` isolates."""
    known = associations.where(F.col("n") >= min_n).select("variant", "drug", (F.col("n_r") / F.col("n")).alias("prior"))
    return rows.join(known.hint("merge"), ["variant", "drug"], "left")


def with_metadata(isolates: DataFrame, metadata: DataFrame, partition: str | None = None) -> DataFrame:
    """Isolates with lineage and site of their metadata where it has them; with ``partition`` only those of that partition."""
    m = metadata.select("isolate_id", F.col("lineage").alias("_l"), F.col("site_id").alias("_s"), "partition", F.lit(True).alias("_m"))
    out = isolates.join(m.hint("merge"), "isolate_id", "left")
    out = out.where(F.col("partition") == partition) if partition else out
    return out.select("isolate_id", F.coalesce("_l", "lineage").alias("lineage"), F.coalesce("_s", "site_id").alias("site_id"), F.col("_m").isNotNull().alias("described"))


def co_observed_classes(rules: DataFrame, variants: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``co_observed`` in two tables: (sample_id, key_a, key_b, class) without repeats, and (class, rule, drug).

    Rules of a drug with the same selectors are one class, so pairs of variants are
    formed once for all of them, and what is shuffled does not grow with the number of rules.
    """
    allowed = results.where("call = 'resistant' AND tier = 'catalogued'").select("sample_id", "drug").distinct()
    open_ = rules.select("rule", "drug", "primary", "partner").join(sized(allowed.select("drug").distinct()), "drug", "left_semi")
    keyed, members = classes(open_, ["rule", "drug"], ["drug", "primary", "partner"])
    selectors = F.explode(F.array_distinct(F.array("variant_key", "gene")))
    named = dealt(variants.select("sample_id", "variant_key", selectors.alias("_s")), "sample_id").distinct()
    side = lambda selector, key: named.select("sample_id", F.col("_s").alias(selector), F.col("variant_key").alias(key)).join(sized(keyed.select(selector).distinct()), selector, "left_semi")
    one = side("primary", "key_a").join(dealt(allowed, "sample_id").hint("merge"), "sample_id")
    pairs = one.join(side("partner", "key_b").hint("merge"), "sample_id").where("key_a <> key_b")
    found = pairs.join(sized(keyed), ["drug", "primary", "partner"]).select("sample_id", "key_a", "key_b", "class").distinct()
    return found, members


def co_observed(rules: DataFrame, variants: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs of variants of a sample that a rule (rule, drug, primary, partner: key or gene) names, where the drug is resistant by the catalogue.

    Pairs are told apart from themselves and named once; they are notes and change no call.
    """
    found, members = co_observed_classes(rules, variants, results)
    return found.join(sized(members), "class").select("sample_id", "drug", "rule", "key_a", "key_b")


def expression_links(observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each observation (observation_id, sample_id, gene, linked_key) with the drugs of regulatory evidence of its gene or linked variant; unlinked ones stay."""
    rows = evidence.select("sample_id", F.col("gene").alias("_g"), F.col("variant_key").alias("_k"), "drug")
    by_gene = observations.join(rows.hint("merge"), "sample_id").where("gene = _g OR linked_key = _k").select("observation_id", "drug").distinct()
    drugs = by_gene.groupBy("observation_id").agg(F.array_join(F.sort_array(F.collect_list("drug")), ",").alias("drugs"))
    out = observations.join(drugs.hint("merge"), "observation_id", "left")
    return out.select("observation_id", "sample_id", "gene", F.coalesce("drugs", F.lit("")).alias("drugs"), F.when(F.col("drugs").isNull(), "unlinked").otherwise("linked").alias("status"))


def with_predictions(results: DataFrame, predicted: DataFrame) -> DataFrame:
    """Results (sample_id, drug, call, genomic_call, phenotypic_call) with predicted categories; a conflict with the genomic call leaves them indeterminate unless a phenotype is established."""
    p = predicted.select("sample_id", "drug", F.col("call").alias("predicted"))
    out = results.join(p.hint("merge"), ["sample_id", "drug"], "left")
    conflict = F.coalesce(F.col("genomic_call").isin(*ESTABLISHED) & F.col("predicted").isNotNull() & (F.col("predicted") != F.col("genomic_call")), F.lit(False))
    measured = F.coalesce(F.col("phenotypic_call").isin(*ESTABLISHED), F.lit(False))
    return out.withColumn("conflict", conflict).withColumn("call", F.when(conflict & ~measured, "indeterminate").otherwise(F.col("call")))


def changed_results(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of two reports that differ, with both calls (absent: not in that report) and whether the call changed."""
    side = lambda df, x: df.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in columns], F.lit(True).alias(f"_{x}"))
    out = side(before, "before").join(side(after, "after").hint("merge"), keys, "outer")
    same: Column = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    for c in columns:
        same = same & F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    shown = lambda x: F.when(F.col(f"_{x}").isNull(), "absent").otherwise(F.col(f"call_{x}")).alias(x)
    changed = F.col("_before").isNull() | F.col("_after").isNull() | ~F.col("call_before").eqNullSafe(F.col("call_after"))
    return out.where(~same).select(*keys, shown("before"), shown("after"), changed.alias("call_changed"))


def tickets(results: DataFrame, existing: DataFrame) -> DataFrame:
    """New tickets: established genomic and phenotypic calls that contradict each other, not opened before."""
    apart = results.where(F.col("genomic_call").isin(*ESTABLISHED) & F.col("phenotypic_call").isin(*ESTABLISHED) & (F.col("genomic_call") != F.col("phenotypic_call")))
    ids = apart.withColumn("ticket_id", F.sha2(F.concat_ws("|", F.col("site_id").cast("string"), F.col("sample_id").cast("string"), "drug"), 256))
    new = ids.join(existing.select("ticket_id").distinct().hint("merge"), "ticket_id", "left_anti")
    return new.select("ticket_id", "site_id", "sample_id", "drug", "genomic_call", "phenotypic_call")


def watch_list(open_tickets: DataFrame, min_isolates: int = 5, min_sites: int = 2) -> DataFrame:
    """Per drug: distinct unresolved (site, isolate) and sites, released only over both floors."""
    cells = open_tickets.where("status <> 'resolved'").groupBy("drug").agg(F.count_distinct(F.struct("site_id", "isolate_id")).alias("n"), F.count_distinct("site_id").alias("sites"))
    enough = (F.col("n") >= min_isolates) & (F.col("sites") >= min_sites)
    return cells.select("drug", enough.alias("released"), F.when(enough, F.col("n")).alias("unresolved_isolates"), F.when(enough, F.col("sites")).alias("contributing_sites"))


def local_verdicts(records: DataFrame, retracted: DataFrame) -> DataFrame:
    """Per (variant, drug): the call all records agree on that were not retracted, else indeterminate, with isolates, sites and lineages.

    ``records`` has arrival; a retraction names the index of a record within its (variant, drug), from 0.
    """
    order = Window.partitionBy("variant", "drug").orderBy("arrival")
    numbered = records.withColumn("record_index", F.row_number().over(order) - 1)
    left = numbered.join(retracted.select("variant", "drug", "record_index").distinct().hint("merge"), ["variant", "drug", "record_index"], "left_anti")
    one = F.count_distinct("result") == 1
    return left.groupBy("variant", "drug").agg(
        F.when(one, F.min("result")).otherwise("indeterminate").alias("call"), F.count("*").alias("n_records"), F.count_distinct("isolate_id").alias("n_isolates"), F.count_distinct("site_id").alias("n_sites"),
        F.array_join(F.array_sort(F.collect_set("lineage")), ",").alias("lineages"),
    )


def historical_evidence(variants: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What a site found before about a variant: indeterminate rows of historical scope, whatever the verdict was."""
    rows = variants.select("sample_id", "variant").distinct().join(verdicts.select("variant", "drug").hint("merge"), "variant")
    return rows.withColumns({"call": F.lit("indeterminate"), "tier": F.lit("inferred"), "scope": F.lit("historical")})


def model_verdicts(performance: DataFrame) -> DataFrame:
    """Add beats: coverage not below the incumbent's and error strictly lower, and why not; ``all_beat`` per model tells whether every row does."""
    short = F.col("call_rate") < F.col("base_coverage")
    worse = F.col("error_rate") >= F.col("base_error")
    reason = F.when(short, "answers less").when(F.col("error_rate") == F.col("base_error"), "matches").when(worse, "errs more")
    out = performance.withColumn("reason", reason).withColumn("beats", F.coalesce(~short & ~worse, F.lit(False)))
    return out.withColumn("all_beat", F.bool_and("beats").over(Window.partitionBy("model")))


def frequency_groups(findings: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Groups of two or more variants of a sample whose fractions lie within ``tolerance`` of the group's first: sample_id, group, size, median_vaf.

    The span of a group is bounded, so distant fractions do not chain. Fractions count to
    six places and equal ones are counted first, so a sample has at most a million and
    one rows; they pass in order through one task, which holds a batch and the group's
    first fraction.
    """
    exact = findings.where("vaf BETWEEN 0 AND 1").select("sample_id", F.round(F.col("vaf").cast("decimal(12,6)") * 1_000_000).cast("long").alias("_v"), "variant_key").distinct()
    counted = exact.groupBy("sample_id", "_v").agg(F.count("*").alias("_n"))
    span = int(Decimal(str(tolerance)).scaleb(6).to_integral_value())

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh, last = first_of_group(batch, ["sample_id"], last)
            values, out = batch.column("_v").to_numpy(), np.zeros(batch.num_rows, np.int64)
            edges = np.flatnonzero(fresh).tolist()
            for a, b in itertools.pairwise(sorted({0, *edges, batch.num_rows})):
                at = a
                if fresh[a]:
                    start = int(values[a])
                while at < b:  # a sample has at most one group for each span
                    end = at + int(np.searchsorted(values[at:b], start + span, "right"))
                    out[at:end] = start
                    at = end
                    if at < b:
                        start = int(values[at])
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), pa.array(out), batch.column("_v"), batch.column("_n")], ["sample_id", "_start", "_v", "_n"])

    kind = findings.schema["sample_id"].dataType.simpleString()
    placed = counted.repartition("sample_id").sortWithinPartitions("sample_id", "_v").mapInArrow(grouped, f"sample_id {kind}, _start long, _v long, _n long")
    out = placed.groupBy("sample_id", "_start").agg(F.sum("_n").alias("size"), F.percentile(F.col("_v") / 1_000_000, 0.5, F.col("_n")).alias("median_vaf"))
    return out.where("size >= 2").select("sample_id", (F.col("_start") / 1_000_000).alias("group"), "size", "median_vaf")


def population_class(groups: DataFrame, hints: DataFrame) -> DataFrame:
    """Per sample with groups: possible_coinfection where two groups have different sourced lineages, else indeterminate."""
    known = groups.join(hints.select("sample_id", "group", "lineage").hint("merge"), ["sample_id", "group"], "left")
    out = known.groupBy("sample_id").agg(F.count("*").alias("n_groups"), F.count_distinct("lineage").alias("n_lineages"))
    return out.withColumn("classification", F.when(F.col("n_lineages") >= 2, "possible_coinfection").otherwise("indeterminate"))


def uncertain_ranking(pairs: DataFrame, dimensions: DataFrame, order: dict[str, int], min_dimensions: int = 5) -> DataFrame:
    """Rank of uncertain (variant, drug) pairs: mean of their available dimensions (each put between 0 and 1) if there are enough, then the consequence.

    ``pairs`` has variant, drug, consequence; ``dimensions`` has variant, dimension, value (null: not available).
    """
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "value"))
    scores = dimensions.where("value IS NOT NULL").groupBy("variant").agg(F.count("*").alias("n_dimensions"), F.round(F.avg(value), 3).alias("_mean"))
    out = pairs.join(scores.hint("merge"), "variant", "left").withColumn("n_dimensions", F.coalesce("n_dimensions", F.lit(0)))
    score = F.when(F.col("n_dimensions") >= min_dimensions, F.col("_mean"))
    triage = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("consequence")), F.lit(7))
    band = F.when(score.isNull(), "insufficient-data").when(score >= 0.66, "high").when(score >= 0.33, "moderate").otherwise("low")
    return out.select("variant", "drug", "consequence", "n_dimensions", score.alias("score"), band.alias("priority"), triage.alias("triage")).orderBy(F.col("score").desc_nulls_last(), "triage", "variant", "drug")
