"""Joins on keys that may be null, with tables of any size, and over classes of rows with equal keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.sources.scratch import stored


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", hint: str = "merge") -> DataFrame:
    """Join in which null keys equal each other; the result has the left side's keys once."""
    named = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return left.join(named.hint(hint), same, how).drop(*[f"_key_{k}" for k in keys])


def sized(df: DataFrame, limit: int = 500_000) -> DataFrame:
    """The table, written once and counted: to be broadcast up to ``limit`` rows, beyond it to be merged.

    For tables that join by few keys, where a shuffle would bring all rows of a key to one task.
    """
    kept = stored(df, "sized")
    return kept.hint("broadcast" if kept.count() <= limit else "merge")


def rewritten(df: DataFrame, columns: list[str], write: Callable[[Column], Column], limit: int = 100_000) -> DataFrame:
    """The table, written once, with ``write`` over text columns: applied to each distinct row of them, or to all rows where more than ``limit`` are distinct."""
    kept = stored(df, "rewritten")
    told = stored(kept.select(*columns).distinct().withColumns({f"_w_{c}": write(F.col(c)) for c in columns}), "texts")
    if told.count() > limit:
        return kept.withColumns({c: write(F.col(c)) for c in columns})
    return null_safe(kept, told, columns, hint="broadcast").withColumns({c: F.col(f"_w_{c}") for c in columns}).drop(*[f"_w_{c}" for c in columns])


def classes(df: DataFrame, members: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(class, *keys) and (class, *members): members of a class have the same set of keys, and each is in one class.

    What meets keys is made distinct by class; its rows are then only listed, however
    many members a class has, and no member comes twice.
    """
    held = df.select(*members, *[F.col(k).alias(f"_{k}") for k in keys]).groupBy(*members).agg(F.sort_array(F.collect_set(F.struct(*[F.col(f"_{k}").alias(k) for k in keys]))).alias("_keys"))
    held = stored(held, "held")
    ids = stored(held.select("_keys").distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    return ids.select("class", F.explode("_keys").alias("_k")).select("class", "_k.*"), held.join(ids.hint("merge"), "_keys").select("class", *members)


#: Rows of a class and members of it that ``listed`` brings together at a time, on average.
TILE = 256


def _tasks(spark: SparkSession) -> int:
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def listed(found: DataFrame, members: DataFrame, limit: int = 500_000) -> DataFrame:
    """Rows of ``found`` (class, batch) with the members (class) of their class, tile by tile.

    A batch of rows meets a part of the members, which come in the same order for each
    row. So in a columnar file of the result rows are runs and members a short cycle, and it
    stays small although it has as many rows as there are pairs. ``batch`` cuts a class into
    about ``TILE`` rows, members are cut here; up to ``limit`` of them are broadcast. A
    table without batches is joined row by row.
    """
    if "batch" not in found.columns:
        return found.join(sized(members, limit), "class").drop("class")
    rows, parts = ([c for c in df.columns if c not in ("class", "batch")] for df in (found, members))
    batches = found.groupBy("class", "batch").agg(F.collect_list(F.struct(*rows)).alias("_rows"))
    sizes = members.groupBy("class").agg(F.count("*").alias("_n"))
    cut = members.join(sizes.hint("merge"), "class").withColumn("_part", F.pmod(F.xxhash64(*parts), F.ceil(F.col("_n") / TILE)))
    cut = stored(cut.groupBy("class", "_part").agg(F.collect_list(F.struct(*parts)).alias("_members")).select("class", "_members"), "members")
    few = (cut.agg(F.sum(F.size("_members")).alias("n")).first().n or 0) <= limit
    tiles = batches.join(cut.hint("broadcast" if few else "merge"), "class").select(F.inline("_rows"), "_members")
    # Members are listed apart from the step before, or values of a row would be read again for each of them. No partitions are joined.
    return tiles.coalesce(_tasks(found.sparkSession)).select(*rows, F.inline("_members"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to a few tasks for each core, which no coalescing takes back: for rows that later become many."""
    return df.repartition(_tasks(df.sparkSession), *keys)


#: Rows that one task sorts or gathers: about 50 MB for each sort.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by keys to one task for each ``TASK_ROWS`` of ``rows``; left as they are where the session has as many cores and shuffle partitions.

    For tables that are joined or grouped by the keys: with a fixed number of partitions,
    or one to which they are coalesced, what a task sorts would grow with the table.
    """
    spark = df.sparkSession
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) else df
