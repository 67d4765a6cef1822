"""Accuracy with abstention: confusion counts, rates, intervals, verdicts, concordance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CALLED = ("resistant", "susceptible")
#: Fixed: the normal quantile of a 95 % interval.
Z95 = 1.959963985
TARGETS = "drug string, min_sensitivity double, min_specificity double, min_call_rate double, min_evaluable int"


def targets(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Target table; the ceilings of both error rates follow from sensitivity and specificity."""
    return spark.createDataFrame(rows, TARGETS).select(
        "drug", F.round(1 - F.col("min_sensitivity"), 6).alias("max_vme"), F.round(1 - F.col("min_specificity"), 6).alias("max_me"),
        "min_call_rate", "min_evaluable",
    )


def normal_call(call: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(call), F.lit(""))))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def known_lineage(lineage: str) -> Column:
    """Blank and missing lineages are the stratum ``unknown``."""
    return F.coalesce(F.nullif(F.trim(F.col(lineage)), F.lit("")), F.lit("unknown"))


def _counts(call: str, phenotype: str) -> list[Column]:
    c, p = normal_call(call), F.upper(F.trim(F.col(phenotype)))
    called = c.isin(*CALLED)
    return [
        F.count("*").alias("n_evaluable"), _count(called).alias("n_called"), _count(~called).alias("n_abstained"),
        _count((c == "resistant") & (p == "R")).alias("tp"), _count((c == "resistant") & (p == "S")).alias("fp"),
        _count((c == "susceptible") & (p == "S")).alias("tn"), _count((c == "susceptible") & (p == "R")).alias("fn"),
        _count(~called & (p == "R")).alias("abstained_r"), _count(~called & (p == "S")).alias("abstained_s"),
    ]


def _evaluable(df: DataFrame, phenotype: str) -> DataFrame:
    return df.where(F.upper(F.trim(F.col(phenotype))).isin("R", "S"))


def confusion(df: DataFrame, by: list[str], call: str = "call_a", phenotype: str = "phenotype") -> DataFrame:
    """Confusion counts per group; a missing or other call is an abstention, not a negative."""
    return _evaluable(df, phenotype).groupBy(*by).agg(*_counts(call, phenotype))


def confusion_by_lineage(df: DataFrame, call: str = "call_a", phenotype: str = "phenotype") -> DataFrame:
    """Per drug and per (drug, lineage) in one pass; the pooled row has the lineage ``all``."""
    rows = _evaluable(df, phenotype).withColumn("_lineage", known_lineage("lineage"))
    sets = rows.groupingSets([["drug"], ["drug", "_lineage"]], "drug", "_lineage")
    out = sets.agg(*_counts(call, phenotype), F.grouping("_lineage").alias("_pooled"))
    return out.withColumn("lineage", F.when(F.col("_pooled") == 1, "all").otherwise(F.col("_lineage"))).drop("_pooled", "_lineage")


def _rate(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def with_rates(counts: DataFrame) -> DataFrame:
    """Rates of confusion counts; a rate without a denominator is null."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({
        "call_rate": _rate(F.col("n_called"), F.col("n_evaluable")), "sensitivity": _rate(tp, tp + fn), "specificity": _rate(tn, tn + fp),
        "ppv": _rate(tp, tp + fp), "npv": _rate(tn, tn + fn), "vme_rate": _rate(fn, tp + fn), "me_rate": _rate(fp, tn + fp),
    })


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; null without a total."""
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low, high = F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)
    return F.when(n.isNotNull(), low), F.when(n.isNotNull(), high)


def with_intervals(rates: DataFrame, min_evaluable: Column | int = 20) -> DataFrame:
    """Wilson intervals of five rates, withheld where the group has too few evaluable rows."""
    enough = F.col("n_evaluable") >= min_evaluable
    pairs = {
        "sensitivity": (F.col("tp"), F.col("tp") + F.col("fn")), "specificity": (F.col("tn"), F.col("tn") + F.col("fp")),
        "vme_rate": (F.col("fn"), F.col("tp") + F.col("fn")), "me_rate": (F.col("fp"), F.col("tn") + F.col("fp")),
        "call_rate": (F.col("n_called"), F.col("n_evaluable")),
    }
    new = {}
    for name, (a, b) in pairs.items():
        low, high = wilson(a, b)
        new |= {f"{name}_low": F.when(enough, low), f"{name}_high": F.when(enough, high)}
    return rates.withColumns(new)


def verdicts(rates: DataFrame, goals: DataFrame) -> DataFrame:
    """Outcome per group against targets: not-targeted, underpowered, fail or pass, with the breaches.

    ``goals`` has one row per drug and is checked to be small before it is broadcast.
    """
    hint = "broadcast" if goals.count() <= 10_000 else "merge"
    joined = rates.join(goals.hint(hint), "drug", "left")
    breaches = {
        "VME above bound": F.col("vme_rate") > F.col("max_vme"), "ME above bound": F.col("me_rate") > F.col("max_me"), "call rate below bound": F.col("call_rate") < F.col("min_call_rate"),
    }
    unknown = {"VME not estimable": F.col("vme_rate").isNull(), "ME not estimable": F.col("me_rate").isNull(), "call rate not estimable": F.col("call_rate").isNull()}
    failed = F.lit(False)
    for breach in breaches.values():
        failed = failed | F.coalesce(breach, F.lit(False))
    outcome = (
        F.when(F.col("min_evaluable").isNull(), "not-targeted").when(F.col("n_evaluable") < F.col("min_evaluable"), "underpowered")
        .when(failed, "fail").otherwise("pass")
    )
    listed = F.array_compact(F.array(*[F.when(gap, F.lit(lacks)).when(breach, F.lit(says)) for (says, breach), (lacks, gap) in zip(breaches.items(), unknown.items(), strict=True)]))
    out = joined.withColumn("verdict", outcome)
    return out.withColumn("reasons", F.when(F.col("verdict").isin("pass", "fail"), F.array_join(listed, "; ")).otherwise(""))


def concordance(df: DataFrame, a: str = "call_a", b: str = "call_b") -> DataFrame:
    """Agreement of two engines per drug, rated only where both called."""
    x, y = normal_call(a), normal_call(b)
    p, q = x.isin(*CALLED), y.isin(*CALLED)
    out = df.groupBy("drug").agg(
        F.count("*").alias("n_compared"), _count(p & q & (x == y)).alias("agree"), _count(p & q & (x != y)).alias("disagree"),
        _count(p & ~q).alias("only_a"), _count(~p & q).alias("only_b"), _count(~p & ~q).alias("neither"),
    )
    return out.withColumn("agreement_rate", _rate(F.col("agree"), F.col("agree") + F.col("disagree")))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Call tables of two engines side by side; a row missing on one side has a null call there."""
    left = a.select("sample_id", "drug", F.col("call").alias("call_a"))
    right = b.select("sample_id", "drug", F.col("call").alias("call_b"))
    return left.join(right, ["sample_id", "drug"], "outer")


def engine_agreement(df: DataFrame) -> DataFrame:
    """Per (sample, drug) over any number of engines: agreed, disagreed, single source or unassessed.

    The two calls are counted, as a smallest and a largest text would be sorted for.
    """
    call = normal_call("call")
    out = df.groupBy("sample_id", "drug").agg(_count(call.isin(*CALLED)).alias("n_called"), _count(call == CALLED[0]).alias("_first"))
    state = F.when(F.col("n_called") == 0, "unassessed").when(F.col("n_called") == 1, "single_source").when(F.col("_first").isin(F.lit(0), F.col("n_called")), "agreed").otherwise("disagreed")
    return out.withColumn("state", state).drop("_first")


def species_control(df: DataFrame, call: str = "call_a") -> DataFrame:
    """Control samples: any drug called is a failure, with the offending drugs."""
    c = normal_call(call)
    bad = F.when(c.isin(*CALLED), F.concat("drug", F.lit("="), c))
    return df.groupBy("sample_id").agg(F.count(bad).alias("n_offending"), F.array_join(F.sort_array(F.collect_set(bad)), ", ").alias("offending")).withColumn(
        "passed", F.col("n_offending") == 0
    )


def call_distribution(df: DataFrame, call: str = "call_a") -> DataFrame:
    """Rows and share of each call per drug."""
    counts = df.groupBy("drug", normal_call(call).alias("call")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("drug").agg(F.sum("n").alias("_all"))
    return counts.join(totals, "drug").withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def call_matrix(df: DataFrame, drugs: list[str], call: str = "call_a") -> DataFrame:
    """One row per sample, one column per drug of the given list."""
    return df.groupBy("sample_id").pivot("drug", drugs).agg(F.max(normal_call(call)))
