"""All evidence of a (sample, drug) reconciled to one call; nothing missing becomes a negative."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: call states in order of precedence after conflicts.
ORDER = ("resistant", "indeterminate", "no_call")
#: Fixed: the basis of a call and its rank.
TIERS = {"phenotypic": 4, "catalogued": 3, "inferred": 2, "predicted": 1, "none": 0}
#: Fixed: per organism and drug, what must be known (None) or found before silence may speak for susceptibility.
ORGANISM_RULES = {("mabscessus", "clarithromycin"): {"subspecies": None, "erm41_status": "nonfunctional", "rrl_status": "wild_type"}}


def permits(scopes: DataFrame, contexts: DataFrame, qc: DataFrame, required: tuple[str, ...] = ("species_confirmation", "contamination")) -> DataFrame:
    """(isolate_id, drug, engine) that a validated scope allows: organism as reviewed and every required check passed.

    A check that is missing has not passed; one that was made twice must pass both times.
    """
    passed = qc.where(F.col("qc_check").isin(*required)).groupBy("isolate_id", "qc_check").agg(F.bool_and(F.col("status").eqNullSafe("pass")).alias("_ok"))
    sound = passed.where("_ok").groupBy("isolate_id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(required)).select("isolate_id")
    hint = "broadcast" if scopes.count() <= 100_000 else "merge"
    return contexts.join(sound.hint("merge"), "isolate_id").join(scopes.distinct().hint(hint), "organism").select("isolate_id", "drug", "engine").distinct()


def organism_refusals(pairs: DataFrame, states: DataFrame, rules: dict[tuple[str, str], dict[str, str | None]] = ORGANISM_RULES) -> DataFrame:
    """(isolate_id, drug, unmet) of the pairs whose organism's rule forbids to read silence as susceptibility.

    ``states`` has isolate_id, organism and a column for every field that a rule names.
    Null and blank fields are unmet. An isolate without a row, or whose organism is null or
    blank, falls under every rule of its drug. Isolates with several rows must meet the rule
    in each; ``unmet`` lists the fields in the rule's order. Without rules nothing is refused.
    """
    known = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    fields = sorted({f for rule in rules.values() for f in rule})
    under = pairs.where(F.col("drug").isin(*sorted({d for _, d in rules}))).select("isolate_id", "drug").distinct()
    told = under.join(states.select("isolate_id", known("organism").alias("_organism"), *[known(f).alias(f"_{f}") for f in fields]).hint("merge"), "isolate_id", "left")
    unmet = []
    for (organism, drug), rule in rules.items():
        applies = (F.col("drug") == drug) & F.coalesce(F.col("_organism") == organism, F.lit(True))
        unmet += [F.when(applies & ~F.coalesce(F.col(f"_{f}").isNotNull() if needed is None else F.col(f"_{f}") == needed, F.lit(False)), f) for f, needed in rule.items()]
    order = list(dict.fromkeys(f for rule in rules.values() for f in rule))
    if not unmet:
        return under.withColumn("unmet", F.lit(""))
    missing = told.select("isolate_id", "drug", F.array_compact(F.array(*unmet)).alias("_unmet")).where("size(_unmet) > 0")
    some = missing.groupBy("isolate_id", "drug").agg(*[F.bool_or(F.array_contains("_unmet", f)).alias(f"_{f}") for f in order])
    return some.select("isolate_id", "drug", F.concat_ws(",", *[F.when(F.col(f"_{f}"), f) for f in order]).alias("unmet"))


def reconcile(evidence: DataFrame, gate: DataFrame, allowed: DataFrame, catalogue_engine: str = "catalogue", refused: DataFrame | None = None) -> DataFrame:
    """One call per (isolate, drug) of ``gate``, with tier and reason.

    ``evidence`` has isolate_id, drug, call, tier, scope (isolate or variant),
    asserts_coverage and engine; ``gate`` says whether the loci are adequate, ``allowed``
    names what validated scopes permit (see ``permits``). Resistant and isolate-wide
    susceptible evidence conflict; else resistant, indeterminate, no call, then what
    ``refused`` names (see ``organism_refusals``) as indeterminate, then an
    engine's own susceptibility if a scope permits it, then loci that are not callable,
    then the catalogue's silence if a scope permits that. One established phenotype
    decides, several that differ do not; any conflict leaves the pair indeterminate.
    """
    rank = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])[F.col("tier")]
    genomic = F.col("tier") != "phenotypic"
    wide = (F.col("call") == "susceptible") & (F.col("scope") == "isolate")
    asserted = genomic & wide & F.col("asserts_coverage")
    best = lambda c: F.max(F.when(c, rank))
    known = evidence.join(allowed.withColumn("_permitted", F.lit(True)).hint("merge"), ["isolate_id", "drug", "engine"], "left")
    facts = known.groupBy("isolate_id", "drug").agg(
        *[best(genomic & (F.col("call") == c)).alias(f"_{c}") for c in ORDER], best(genomic).alias("_all"), best(genomic & wide).alias("_wide"),
        best(F.col("call") == "resistant").alias("_any_resistant"), best(wide).alias("_any_wide"),
        best(asserted).alias("_asserted"), best(asserted & F.col("_permitted")).alias("_permitted"),
        F.min(F.when(~genomic, F.col("call"))).alias("_first"), F.max(F.when(~genomic, F.col("call"))).alias("_last"), F.count("*").alias("n_evidence"),
    )
    catalogued = allowed.where(F.col("engine") == catalogue_engine).select("isolate_id", "drug", F.lit(True).alias("_catalogued"))
    joined = gate.select("isolate_id", "drug", "adequate").join(facts.hint("merge"), ["isolate_id", "drug"], "left").join(catalogued.hint("merge"), ["isolate_id", "drug"], "left")
    if refused is not None:
        joined = joined.join(refused.select("isolate_id", "drug", F.lit(True).alias("_refused")).distinct().hint("merge"), ["isolate_id", "drug"], "left")
    rules = [(F.col("_resistant").isNotNull() & F.col("_wide").isNotNull(), "indeterminate", F.col("_all"), "conflict")]
    rules += [(F.col(f"_{c}").isNotNull(), c, F.col(f"_{c}"), "evidence") for c in ORDER]
    rules += [] if refused is None else [(F.col("_refused").isNotNull(), "indeterminate", F.lit(0), "organism")]
    rules += [
        (F.col("_permitted").isNotNull(), "susceptible", F.col("_permitted"), "asserted"), (~F.col("adequate") & F.col("_asserted").isNull(), "not_assessed", F.lit(0), "loci"),
        (F.col("adequate") & F.col("_catalogued"), "susceptible", F.lit(TIERS["catalogued"]), "catalogue"),
    ]
    found = F.struct(F.lit("indeterminate").alias("call"), F.lit(0).alias("tier"), F.lit("no scope").alias("reason"))
    for condition, call, tier, reason in reversed(rules):
        found = F.when(condition, F.struct(F.lit(call).alias("call"), tier.alias("tier"), F.lit(reason).alias("reason"))).otherwise(found)
    measured = F.when(F.col("_first") == F.col("_last"), F.col("_first")).when(F.col("_first").isNotNull(), "indeterminate")
    settled = F.coalesce(measured.isin("resistant", "susceptible"), F.lit(False))
    clash = F.col("_any_resistant").isNotNull() & F.col("_any_wide").isNotNull()
    out = joined.withColumn("_g", found).withColumn("_m", measured)
    call = F.when(clash | (F.col("_m").isNotNull() & ~settled), "indeterminate").when(settled, F.col("_m")).otherwise(F.col("_g.call"))
    reason = F.when(clash, "conflict").when(settled, "phenotype").when(F.col("_m").isNotNull(), "phenotypes").otherwise(F.col("_g.reason"))
    tier = F.when(settled, TIERS["phenotypic"]).otherwise(F.col("_g.tier"))
    names = F.element_at(F.create_map(*[F.lit(x) for k, v in TIERS.items() for x in (v, k)]), tier)
    return out.select(
        "isolate_id", "drug", F.col("_g.call").alias("genomic_call"), F.col("_m").alias("phenotypic_call"), call.alias("call"), names.alias("tier"), reason.alias("reason"),
        F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"),
    )


def regimens(results: DataFrame, members: DataFrame) -> DataFrame:
    """Per (isolate, regimen): usable, resistant and unestablished drugs and the shortfall.

    ``members`` has regimen, drug, min_required; it is a small profile, counted before the broadcast.
    """
    if members.count() > 10_000:
        raise ValueError("a profile of regimens is expected to be small")
    joined = results.join(F.broadcast(members), "drug")
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("drug")))), ",")
    usable, resistant = F.col("call") == "susceptible", F.col("call") == "resistant"
    out = joined.groupBy("isolate_id", "regimen", "min_required").agg(
        F.count(F.when(usable, 1)).alias("n_usable"), listed(resistant).alias("resistant"), listed(~usable & ~resistant).alias("unestablished")
    )
    return out.withColumn("shortfall", F.greatest(F.lit(0), F.col("min_required") - F.col("n_usable")).cast("long")).withColumn("eligible", F.col("shortfall") == 0)
