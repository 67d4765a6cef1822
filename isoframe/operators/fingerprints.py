"""Fingerprints of tables and locks that certify one: equal however the rows are split, and cheap to compare where little changed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encoded(columns: list[str]) -> Column:
    """The row as text from which every value can be read back: each with its length, a null as ``-``."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    return F.concat(*[F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns])


def _sums(digest: Column) -> list[Column]:
    """Rows and two order-free sums over 60-bit pieces of the digest, exact on any number of rows."""
    piece = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return [F.count("*").alias("n"), piece(1).alias("sum_a"), piece(16).alias("sum_b")]


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n, sum_a and sum_b over the SHA-256 of every row. Null and empty differ, as do values that run on into the next column."""
    return df.select(F.sha2(encoded(columns), 256).alias("_d")).agg(*_sums(F.col("_d")))


def digests(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """item (the keys as text, joined by commas), bucket (four hex digits of the keys' hash) and digest of every row."""
    item = F.concat_ws(",", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in keys])
    return df.select(item.alias("item"), F.substring(F.sha2(encoded(keys), 256), 1, 4).alias("bucket"), F.sha2(encoded(columns), 256).alias("digest"))


def changed(before: DataFrame, after: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """item and change (added, removed, changed) of rows that differ between two tables of ``digests``.

    Sums of 256 buckets are compared first, then those of the finer buckets inside the
    ones that differ; only rows of finer buckets that differ are shuffled. A key that repeats
    is one item with all its rows.
    """
    for width in (2, 4):
        side = lambda df, x: df.groupBy(F.substring("bucket", 1, width).alias("_b")).agg(*_sums(F.col("digest"))).select("_b", F.struct("n", "sum_a", "sum_b").alias(x))
        both = side(before, "x").join(side(after, "y").hint("merge"), "_b", "outer")
        differ = store(both.where("NOT x <=> y").select("_b"), "buckets")
        # At most 256, then 65,536 short texts.
        inside = lambda df: df.join(F.broadcast(differ), F.substring("bucket", 1, width) == F.col("_b"), "left_semi")
        before, after = inside(before), inside(after)
    rows = before.select("item", "digest", F.lit(1).alias("s")).unionByName(after.select("item", "digest", F.lit(-1).alias("s")))
    net = rows.groupBy("item", "digest").agg(F.sum("s").alias("s"), F.count(F.when(F.col("s") > 0, 1)).alias("b"), F.count(F.when(F.col("s") < 0, 1)).alias("a"))
    items = net.groupBy("item").agg(F.max(F.col("s") != 0).alias("_differs"), F.sum("b").alias("_before"), F.sum("a").alias("_after")).where("_differs")
    return items.select("item", F.when(F.col("_before") == 0, "added").when(F.col("_after") == 0, "removed").otherwise("changed").alias("change"))


def write_lock(df: DataFrame, keys: list[str], columns: list[str], evidence: DataFrame, folder: str, version: str) -> None:
    """Lock a table: digests of its rows, its evidence (item, errors), and last one row with version and columns, so a folder with that is whole."""
    digests(df, keys, columns).write.mode("overwrite").parquet(f"{folder}/rows")
    evidence.select("item", "errors").write.mode("overwrite").parquet(f"{folder}/evidence")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name in columns}
    head = [(version, json.dumps({"keys": keys, "columns": [[c, kinds[c]] for c in columns]}))]
    df.sparkSession.createDataFrame(head, "version string, layout string").coalesce(1).write.mode("overwrite").json(f"{folder}/lock")


def violations(df: DataFrame, keys: list[str], columns: list[str], folder: str, version: str, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """kind, item and detail of all that keeps a lock from certifying the table; none if it does.

    Kinds: schema (of another version), columns (names or types changed, then rows are not
    compared), row (added, removed or changed), evidence (a recorded error, blank ones
    aside) and no evidence. A missing lock is an error of the reader.
    """
    spark = df.sparkSession
    head = spark.read.schema("version string, layout string").json(f"{folder}/lock").first()
    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name in columns}
    layout = {"keys": keys, "columns": [[c, kinds.get(c)] for c in columns]}
    told = []
    if head.version != version:
        told.append(("schema", head.version, f"expected {version}"))
    if json.loads(head.layout) != layout:
        told.append(("columns", None, head.layout))
    evidence = spark.read.schema("item string, errors string").parquet(f"{folder}/evidence")
    if evidence.isEmpty():
        told.append(("no evidence", None, None))
    out = spark.createDataFrame(told, "kind string, item string, detail string")
    failed = evidence.where("trim(coalesce(errors, '')) <> ''").select(F.lit("evidence").alias("kind"), "item", F.col("errors").alias("detail"))
    out = out.unionByName(failed)
    if json.loads(head.layout) != layout:
        return out
    locked = spark.read.schema("item string, bucket string, digest string").parquet(f"{folder}/rows")
    rows = changed(locked, store(digests(df, keys, columns), "digests"), store)
    return out.unionByName(rows.select(F.lit("row").alias("kind"), "item", F.col("change").alias("detail")))
