"""Delimited tables with required columns, column aliases, typed JSON rows and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str | list[str], sep: str = "\t", required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of delimited text with a header; comment lines (#) and blank lines are skipped, a byte order mark is tolerated.

    Columns are text. A missing required column is an error that names those found.
    """
    rows = spark.read.option("header", True).option("sep", sep).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    rows = rows.toDF(*[c.removeprefix("\ufeff").strip() for c in rows.columns])
    return with_required(rows, required)


def with_required(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {rows.columns}")
    return rows


def renamed(rows: DataFrame, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns by their names of this library: the first alias (case and outer blanks aside) that the table has; others are left out."""
    found = {c.strip().lower(): c for c in rows.columns}
    chosen = {name: next((found[a.lower()] for a in (name, *known) if a.lower() in found), None) for name, known in aliases.items()}
    out = rows.select(*[F.col(f"`{c}`").alias(name) for name, c in chosen.items() if c is not None])
    return with_required(out, required)


def json_rows(texts: DataFrame, schema: str, field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of texts (file, value) that hold a JSON array, or an object with one in ``field``."""
    kind = f"array<struct<{schema}>>"
    parsed = F.from_json("value", kind) if field is None else F.from_json("value", f"struct<{field}: {kind}>")[field]
    held = texts.withColumn("_rows", parsed)
    rows = held.where("_rows IS NOT NULL").select("file", F.explode("_rows").alias("r")).select("file", "r.*")
    return rows, held.where("_rows IS NULL").select("file", F.lit("no JSON rows").alias("reason"))


def predictions(rows: DataFrame) -> DataFrame:
    """Predictions with normalised values: resistant, susceptible or null (abstained); drugs in lower case."""
    said = F.lower(F.trim(F.coalesce("predicted", F.lit(""))))
    value = F.when(said.isin("r", "resistant"), "resistant").when(said.isin("s", "susceptible"), "susceptible")
    return rows.select(F.trim(F.col("isolate_id").cast("string")).alias("isolate_id"), F.lower(F.trim("drug")).alias("drug"), value.alias("predicted"), F.col("confidence").try_cast("double").alias("confidence"))


def truths(rows: DataFrame, order: str, accepted: tuple[str, ...] = ("HIGH",)) -> DataFrame:
    """Accepted truths of long rows (sample_id, drug, phenotype, quality); the last by ``order`` of each (sample, drug) counts."""
    said = F.upper(F.trim(F.coalesce("phenotype", F.lit(""))))
    good = rows.where(said.isin("R", "S") & F.coalesce(F.upper(F.trim("quality")).isin(*accepted), F.lit(False)))
    key = [F.trim(F.col("sample_id").cast("string")).alias("isolate_id"), F.lower(F.trim("drug")).alias("drug")]
    return good.withColumn("_t", F.when(said == "R", "resistant").otherwise("susceptible")).groupBy(*key).agg(F.max_by("_t", F.struct(order, "_t")).alias("truth"))


def wide_truths(rows: DataFrame, drugs: dict[str, str], order: str, accepted: tuple[str, ...] = ("HIGH",), run: str = "ENA_RUN", prefix: str = "cr_") -> DataFrame:
    """Accepted truths (isolate_id, drug, truth) of a table with one row per run and three columns per drug.

    ``drugs`` maps a column code to its drug: ``{code}_BINARY_PHENOTYPE`` must be R or S and
    ``{code}_PHENOTYPE_QUALITY`` accepted; codes without both columns give no truths. The
    isolate is the run behind ``prefix``; of runs that repeat the last by ``order`` counts.
    """
    said = lambda c: F.upper(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))))
    there = {code: drug for code, drug in drugs.items() if {f"{code}_BINARY_PHENOTYPE", f"{code}_PHENOTYPE_QUALITY"} <= set(rows.columns)}
    if run not in rows.columns or not there:
        raise ValueError(f"expected {run} and columns of phenotype and quality; found {rows.columns}")
    cells = F.array(*[F.struct(F.lit(drug).alias("drug"), said(f"{code}_BINARY_PHENOTYPE").alias("p"), said(f"{code}_PHENOTYPE_QUALITY").alias("q")) for code, drug in there.items()])
    long = rows.select(F.concat(F.lit(prefix), F.coalesce(F.trim(F.col(run).cast("string")), F.lit(""))).alias("isolate_id"), F.col(order).alias("_o"), F.explode(cells).alias("c")).where(F.col("c.p").isin("R", "S") & F.col("c.q").isin(*accepted))
    truth = F.when(F.col("c.p") == "R", "resistant").otherwise("susceptible")
    return long.withColumn("_t", truth).groupBy("isolate_id", F.col("c.drug").alias("drug")).agg(F.max_by("_t", F.struct("_o", "_t")).alias("truth"))


def baselines(texts: DataFrame) -> DataFrame:
    """(drug, base_coverage, base_risk) of texts that hold an object keyed by drug, alone or under ``baselines``; drugs without both numbers are left out."""
    kind = "map<string, struct<coverage: string, error_rate: string>>"
    found = F.coalesce(F.from_json("value", f"struct<baselines: {kind}>")["baselines"], F.from_json("value", kind))
    rows = texts.select(F.explode(found).alias("drug", "b"))
    out = rows.select(F.lower("drug").alias("drug"), F.col("b.coverage").try_cast("double").alias("base_coverage"), F.col("b.error_rate").try_cast("double").alias("base_risk"))
    return out.where("base_coverage IS NOT NULL AND base_risk IS NOT NULL")


def write_results(tables: dict[str, DataFrame], folder: str, facts: dict[str, str], by: dict[str, str] | None = None) -> None:
    """Write each table as Parquet (partitioned by the column named in ``by``) and then one JSON manifest row with facts and counts.

    The manifest comes last, so a folder with one is whole.
    """
    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        (out.partitionBy(by[name]) if by and name in by else out).parquet(f"{folder}/{name}")
        counts[name] = spark.read.parquet(f"{folder}/{name}").count()
    row = {**facts, **{f"n_{k}": str(v) for k, v in counts.items()}}
    spark.createDataFrame([(row,)], "manifest map<string, string>").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
