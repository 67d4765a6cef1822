"""Rows as a reader sees them: supplied figures and evidence with one name for each field, and a stated default where nothing was given.

Every function maps row by row (but for ``population_rows``, which groups by sample) and
takes tables that lack optional columns, hold nulls or blanks, repeat rows or are empty;
columns that it does not name are dropped. A field that was not given is a text that says
so, a number that was not given is null and never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoframe.functions.display import given, percent, readable, readable_all, shown, variant_name, whole
from isoframe.operators.joins import listed, sized

NOT_SUPPLIED = "Not supplied"


def _texts(df: DataFrame, fields: dict[str, tuple[str, ...]]) -> list[Column]:
    """Fields as they were given, first of their names, or the default."""
    return [F.coalesce(given(df, *names), F.lit(NOT_SUPPLIED)).alias(field) for field, names in fields.items()]


def _words(df: DataFrame, fields: dict[str, tuple[str, ...]], default: str = NOT_SUPPLIED) -> list[Column]:
    return [shown(df, default, *names).alias(field) for field, names in fields.items()]


def _key(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, "[_ ]", "-"))


def model_rows(rows: DataFrame) -> DataFrame:
    """External-model figures: texts, rates in percent (also those of the incumbent and at matched coverage), counts, verdict and whether a registry may take them."""
    verdict = F.coalesce(given(rows, "verdict", "baseline_verdict"), F.lit("not supplied"))
    rates = {
        "call_rate": ("call_rate",), "error_rate": ("error_rate",), "baseline_coverage": ("baseline_coverage", "baseline_call_rate"), "baseline_error_rate": ("baseline_error_rate", "baseline_risk"),
        "matched_coverage": ("matched_coverage",), "matched_error_rate": ("matched_error_rate",), "sensitivity": ("sensitivity",), "specificity": ("specificity",),
    }
    counts = {"n_evaluable": ("n_evaluable", "n_predictions"), "n_called": ("n_called",), "n_dropped": ("n_dropped",)}
    return rows.select(
        *_texts(rows, {"model": ("model", "model_id"), "version": ("version", "model_version"), "cohort": ("cohort",), "source": ("source",)}),
        *_words(rows, {"drug": ("drug",)}), shown(rows, "All lineages", "lineage").alias("lineage"),
        *[percent(given(rows, *names)).alias(field) for field, names in rates.items()], *[whole(given(rows, *names)).alias(field) for field, names in counts.items()],
        readable(verdict).alias("verdict"), _key(verdict).alias("verdict_key"), F.coalesce(F.lower(given(rows, "registry_ready")).isin("yes", "true", "1"), F.lit(False)).alias("registry_ready"),
        *_texts(rows, {"notes": ("notes", "reason")}),
    )


def watch_rows(rows: DataFrame) -> DataFrame:
    """Aggregates of a shared watch list; rows without a drug are left out, counts below a floor (null) stay null."""
    held = rows.where(given(rows, "drug").isNotNull())
    return held.select(
        *_words(held, {"drug": ("drug",)}), F.coalesce(variant_name(given(held, "variant", "variant_label")), F.lit("All variants of the drug")).alias("variant"),
        whole(given(held, "unresolved_isolates", "isolate_count", "n_isolates")).alias("unresolved_isolates"), whole(given(held, "contributing_sites", "site_count", "n_sites")).alias("contributing_sites"),
        shown(held, "Under investigation", "status").alias("status"), *_texts(held, {"source": ("source",)}),
    )


def ticket_rows(tickets: DataFrame) -> DataFrame:
    """Tickets of genomic and phenotypic calls that contradict each other: short id, sample, drug, both calls in words and as given, status (open unless said)."""
    status = F.coalesce(given(tickets, "status"), F.lit("open"))
    return tickets.select(
        F.substring(F.coalesce(given(tickets, "ticket_id"), F.lit("")), 1, 12).alias("ticket"), *_texts(tickets, {"sample": ("sample_id",)}), *_words(tickets, {"drug": ("drug",), "genomic_call": ("genomic_call",), "phenotypic_call": ("phenotypic_call",)}),
        given(tickets, "genomic_call").alias("genomic_key"), given(tickets, "phenotypic_call").alias("phenotypic_key"), readable(status).alias("status"), _key(status).alias("status_key"), *_texts(tickets, {"resolution": ("resolution",), "source": ("source",)}),
    )


def target_rows(rows: DataFrame) -> DataFrame:
    """Supplied evidence about targets; rows that name no target are left out."""
    held = rows.where(given(rows, "target", "gene").isNotNull())
    fields = ("essentiality", "druggability", "human_homology", "resistance_liability")
    return held.select(given(held, "target", "gene").alias("target"), *_words(held, {f: (f,) for f in fields}), *_texts(held, {"evidence": ("evidence", "rationale"), "source": ("source",)}))


def audit_rows(entries: DataFrame) -> DataFrame:
    """Ledger entries: when, what, who (unknown unless said), about what, and the first eight letters of the hash."""
    return entries.select(
        given(entries, "timestamp_utc", "timestamp", "ts").alias("at"), readable(given(entries, "action", "event")).alias("event"), F.coalesce(given(entries, "actor", "reviewer"), F.lit("unknown")).alias("actor"),
        F.coalesce(given(entries, "target", "summary"), F.lit("")).alias("target"), F.substring(F.coalesce(given(entries, "hash", "entry_hash"), F.lit("")), 1, 8).alias("hash"),
    )


def _pair() -> Column:
    return F.concat_ws(" + ", variant_name(F.col("key_a").cast("string")), variant_name(F.col("key_b").cast("string"))).alias("pair")


def epistasis_rows(pairs: DataFrame) -> DataFrame:
    """A row for each co-observed pair (``linked.co_observed``: sample_id, rule, drug, key_a, key_b), which notes and decides nothing."""
    return pairs.select(
        *_texts(pairs, {"sample": ("sample_id",), "rule": ("rule",), "source": ("source",)}), *_words(pairs, {"drug": ("drug",)}), shown(pairs, "Annotation only", "interaction").alias("interaction"),
        _pair(), F.lit("Annotation only").alias("effect"),
    )


def epistasis_classes(found: DataFrame, members: DataFrame) -> DataFrame:
    """``epistasis_rows`` of the two tables of ``linked.co_observed_classes``: texts are made before the rules of a class are listed."""
    pairs = found.select("class", *_texts(found, {"sample": ("sample_id",)}), _pair())
    rules = members.select("class", *_texts(members, {"rule": ("rule",), "source": ("source",)}), *_words(members, {"drug": ("drug",)}), shown(members, "Annotation only", "interaction").alias("interaction"))
    return pairs.join(sized(rules), "class").select("sample", "rule", "source", "drug", "interaction", "pair", F.lit("Annotation only").alias("effect"))


def population_rows(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per sample of ``classes`` (sample_id, classification): its frequency groups as an array of fraction, size and lineage, in order of fraction.

    ``groups`` has sample_id, group, size, median_vaf and, optionally, lineage. Groups
    span a tolerance each, so their number in a sample is bounded.
    """
    lineage = shown(groups, "Not assigned", "lineage")
    listed = groups.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(F.round("median_vaf", 6).alias("fraction"), F.col("size").cast("long").alias("size"), lineage.alias("lineage")))).alias("groups"))
    named = classes.select("sample_id", shown(classes, "Indeterminate", "classification").alias("classification"))
    out = named.join(listed.hint("merge"), "sample_id", "left")
    return out.select("sample_id", "classification", F.coalesce(F.size("groups"), F.lit(0)).alias("n_groups"), F.coalesce("groups", F.array().cast(listed.schema["groups"].dataType)).alias("groups"))


def concentration_rows(rows: DataFrame) -> DataFrame:
    """Measured or predicted concentrations as written, with the comparison in words; a comparison that is not decided says so."""
    held = ("sample_id", "isolate_id")
    return rows.select(
        *_texts(rows, {"sample": held, "value": ("mic", "value"), "method": ("method",), "source": ("source",)}), *_words(rows, {"drug": ("drug",)}), given(rows, "unit").alias("unit"),
        shown(rows, "Undecided", "comparison", "call").alias("comparison"), F.coalesce(F.lower(given(rows, "conflict")).isin("true", "1", "yes"), F.lit(False)).alias("conflict"),
    )


def structural_rows(claims: DataFrame) -> DataFrame:
    """Claims about a variant's place in a structure: distance with its unit (or not measured) and status; they change no rank."""
    distance = F.concat_ws(" ", given(claims, "ligand_distance"), F.when(given(claims, "ligand_distance").isNotNull(), given(claims, "distance_unit")))
    return claims.select(
        F.coalesce(variant_name(given(claims, "variant_key", "variant")), F.lit(NOT_SUPPLIED)).alias("variant"), *_texts(claims, {"gene": ("gene",), "effect": ("predicted_effect", "effect"), "source": ("source",)}),
        shown(claims, "Unknown", "location").alias("location"), F.coalesce(F.nullif(distance, F.lit("")), F.lit("Not measured")).alias("distance"), shown(claims, "Unknown", "validation_status", "status").alias("status"), shown(claims, "None", "ranking_effect").alias("ranking_effect"),
    )


def _told(areas: DataFrame) -> DataFrame:
    """Areas with name, type and gene; of an area told twice the smallest counts."""
    one = areas.groupBy("area").agg(F.min(F.struct(given(areas, "name").alias("name"), given(areas, "type").alias("type"), given(areas, "gene").alias("gene"))).alias("_a"))
    return one.select("area", "_a.*")


def _variant() -> Column:
    return F.coalesce(variant_name(F.col("variant_key").cast("string")), F.lit(NOT_SUPPLIED)).alias("variant")


def regulatory_rows(matches: DataFrame, areas: DataFrame) -> DataFrame:
    """Variants in regulatory areas (``lanes.regulatory_matches``) with what is told of the area: gene, how they matched; an area that is not described stays.

    ``areas`` has area and, optionally, name, type, gene; of an area told twice the smallest counts.
    """
    rows = matches.join(_told(areas).hint("merge"), "area", "left")
    return rows.select(
        *_texts(rows, {"sample": ("sample_id",), "area": ("area",), "name": ("name",), "gene": ("gene",)}), _variant(),
        shown(rows, "Unknown", "type").alias("type"), readable(F.col("matched_by")).alias("matched_by"),
    )


def regulatory_classes(parts: list[tuple[DataFrame, DataFrame]], areas: DataFrame) -> DataFrame:
    """``regulatory_rows`` of the tables of ``lanes.regulatory_classes``: texts are made before the areas of a class are listed."""
    told, out = _told(areas), None
    for found, members in parts:
        named = members.join(told.hint("merge"), "area", "left")
        named = named.select("class", *_texts(named, {"area": ("area",), "name": ("name",), "gene": ("gene",)}), shown(named, "Unknown", "type").alias("type"))
        rows = found.select("class", *[c for c in found.columns if c == "batch"], *_texts(found, {"sample": ("sample_id",)}), _variant(), readable(F.col("matched_by")).alias("matched_by"))
        rows = listed(rows, named).select("sample", "area", "name", "gene", "variant", "type", "matched_by")
        out = rows if out is None else out.unionByName(rows)
    return out


def expression_rows(links: DataFrame) -> DataFrame:
    """Expression measurements (``linked.expression_links``) with the drugs they may bear on, in words; they establish no call."""
    drugs = readable_all(F.split(F.coalesce(given(links, "drugs"), F.lit("")), ","))
    return links.select(
        *_texts(links, {"sample": ("sample_id",), "observation": ("observation_id",), "gene": ("gene",), "source": ("provenance", "source")}), shown(links, "Unknown", "measurement_type").alias("measurement"),
        shown(links, "Uncertain", "reported_conclusion").alias("conclusion"), shown(links, "Unlinked", "matching_status", "status").alias("matching"), F.coalesce(drugs, F.lit("None")).alias("drugs"),
    )


def prediction_rows(rows: DataFrame) -> DataFrame:
    """Model predictions (``follow_up.matched_predictions``) and why one may not be shown; what may be shown changes neither call nor rank."""
    model = F.concat_ws(" ", F.coalesce(given(rows, "model", "model_id"), F.lit("Unknown model")), given(rows, "model_version"))
    return rows.select(
        F.coalesce(variant_name(given(rows, "variant_key", "variant")), F.lit(NOT_SUPPLIED)).alias("variant"), *_words(rows, {"drug": ("drug",)}), shown(rows, "Uncertain", "prediction").alias("prediction"), model.alias("model"),
        shown(rows, "All lineages", "lineage").alias("lineage"), F.coalesce(readable(given(rows, "violation")), F.lit("No call or ranking effect")).alias("effect"),
    )


def panel_rows(profile: DataFrame, panel: DataFrame) -> DataFrame:
    """Per drug of the profile (drug, locus): loci declared, loci the panel targets, those it lacks (an array) and whether it supports the drug.

    A drug supports a conclusion only with at least one locus and none lacking. Loci of a drug are a profile's, not the data's.
    """
    marked = profile.select("drug", "locus").distinct().join(panel.select("locus").distinct().withColumn("_in", F.lit(True)).hint("merge"), "locus", "left")
    lacking = F.array_sort(F.collect_set(F.when(F.col("_in").isNull(), F.col("locus"))))
    out = marked.groupBy("drug").agg(F.count("locus").alias("n_loci"), F.count("_in").alias("n_kept"), lacking.alias("missing"))
    return out.select(*_words(out, {"drug": ("drug",)}), "n_loci", "n_kept", "missing", ((F.size("missing") == 0) & (F.col("n_loci") > 0)).alias("supported"))
