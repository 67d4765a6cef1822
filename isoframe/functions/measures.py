"""Measurement rules as column expressions: concentrations, detection, posteriors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concentration_call(value: Column, censoring: Column, critical: Column, inclusive: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """resistant or susceptible where the value's whole interval lies on one side of the critical concentration, else null.

    A left-censored value reaches down to 0, a right-censored one up without end. At the
    critical concentration itself ``inclusive`` (susceptible at the bound) decides, and
    unknown stays unknown; a right-censored bound at it lies above.
    """
    lower = F.when(censoring == "left", 0.0).otherwise(value if low is None else F.coalesce(low, value))
    upper = F.when(censoring == "right", float("inf")).otherwise(value if high is None else F.coalesce(high, value))
    above = (lower > critical) | (lower == critical) & ((censoring == "right") | F.coalesce(inclusive == F.lit(False), F.lit(False)))
    below = (upper < critical) | (upper == critical) & F.coalesce(inclusive, F.lit(False))
    return F.when(above, "resistant").when(below, "susceptible")


def detection_probability(vaf: Column, midpoint: Column, slope: Column) -> Column:
    """Logistic curve of detection over the allele fraction."""
    return 1 / (1 + F.exp(-slope * (vaf - midpoint)))


def posterior(sensitivity: Column, prior: Column, false_rate: Column, replicates: Column) -> Column:
    """Struct (probability, low, high) that a detected allele is real; null where any input is unknown or the prior is none."""
    hit = sensitivity * prior
    total = hit + false_rate * (1 - prior)
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), hit / total))
    spread = F.when(replicates < 5, 0.5).otherwise(F.greatest(F.lit(0.03), 1 / F.sqrt(replicates)))
    known = replicates.isNotNull() & prior.between(0, 1) & (total > 0)
    return F.when(known, F.struct(F.round(p, 4).alias("probability"), F.round(F.greatest(F.lit(0.0), p - spread), 4).alias("low"), F.round(F.least(F.lit(1.0), p + spread), 4).alias("high")))
