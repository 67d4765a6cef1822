"""Wide phenotype tables as long ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def phenotypes_long(wide: DataFrame, drugs: dict[str, str], excluded: DataFrame, run: str = "run", sample: str = "sample_id", accepted: tuple[str, ...] = ("HIGH",)) -> DataFrame:
    """One row per (sample, drug) from columns <code>_phenotype, <code>_quality and <code>_mic.

    ``drugs`` maps codes to names. Samples in ``excluded`` are removed; rows without a run
    are skipped; a pair with neither phenotype nor MIC has no row. evaluable is false with
    a reason where the phenotype is not R or S or its quality is not accepted.
    """
    kept = wide.where(f"nullif(nullif(trim({run}), ''), 'NONE') IS NOT NULL").join(excluded.select(sample).distinct(), sample, "left_anti")
    cells = F.array(*[F.struct(F.lit(name).alias("drug"), *[F.nullif(F.trim(F.col(f"{code}_{c}")), F.lit("")).alias(c) for c in ("phenotype", "quality", "mic")]) for code, name in drugs.items()])
    long = kept.select(sample, run, F.explode(cells).alias("c")).select(sample, run, "c.*").where("phenotype IS NOT NULL OR mic IS NOT NULL")
    reason = F.when(F.col("phenotype").isNull(), "no phenotype").when(~F.upper("phenotype").isin("R", "S"), "not R or S").when(~F.coalesce(F.upper("quality").isin(*accepted), F.lit(False)), "quality")
    return long.withColumns({"reason": reason, "evaluable": reason.isNull()})
