"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Every row gets a global number, the number is permuted inside 0..n-1 by a Feistel
network with cycle walking, and shard and slot are remainder and quotient of the
permuted number. Shard sizes differ by at most one row and slots have no gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_numbers(df: DataFrame, keys: list[str], buckets: int = 1024, name: str = "row_number") -> DataFrame:
    """Number all rows 0..n-1 in an order fixed by ``keys`` alone.

    Rows are numbered inside hash buckets of ``keys``, and each bucket starts where
    the buckets before it end. Only the ``buckets`` counts meet in one place; their
    number is the parameter, so the joined side has a fixed size. Rows that agree in
    all keys may swap numbers among themselves. Use more buckets for more rows: a
    bucket is sorted by one task (with spill).
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
        .select(F.col("_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_bucket").orderBy(*keys)
    return (
        bucketed.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "_bucket")
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_bucket", "_start", "_inside")
    )


def permuted(number: Column, n: int, key: int, rounds: int = 4, walks: int = 160) -> Column:
    """Feistel permutation of 0..n-1 with cycle walking.

    The network permutes 0..4**h - 1, the smallest such range that holds n values;
    numbers that fall outside 0..n-1 are permuted again. At most three quarters of
    the range lie outside, so a number is still outside after ``walks`` steps with
    probability below 0.75 ** walks; that ends the query with an error, never with a
    wrong position.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def network(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(F.lit(mask))
        for k in range(rounds):
            left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(key), F.lit(k)).bitwiseAND(F.lit(mask)))
        return F.shiftleft(left, half).bitwiseOR(right)

    def walk(x: Column, _: Column) -> Column:
        return F.when(x < n, x).otherwise(network(x))

    first = network(number.cast("long"))
    found = F.when(first < n, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, walk))
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def assign_shards(
    docs: DataFrame, shards: int = 40, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text",
    header_bytes: int = 16, buckets: int = 1024,
) -> DataFrame:
    """Columns id, size, text_crc32, position, shard and slot for every row.

    Size is the UTF-8 length of the text (null: 0) plus ``header_bytes``. Null ids and
    texts, empty tables and repeated rows are kept: each row gets a slot of its own.
    A text of any length is read whole for its size and checksum. Columns beside id and
    text are not read, so their names cannot clash. Only ids,
    sizes and checksums are shuffled, never texts.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + header_bytes).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    n = docs.count()
    numbered = row_numbers(rows, ["doc_id", "text_crc32", "size"], buckets, "_row")
    return numbered.withColumn("position", permuted(F.col("_row"), n, key)).select(
        "doc_id", "size", "text_crc32", "position",
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"position div {shards}").cast("long").alias("slot"),
    )


def write_shards(
    docs: DataFrame, path: str, shards: int = 40, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text", file_rows: int = 1_000_000
) -> None:
    """Write all rows with all their columns as Parquet, one folder for each shard, in files of ``file_rows`` slots in slot order.

    Rows that agree in id and checksum may take each other's slots. Columns named shard
    or slot are refused, as these are the ones that are added.
    """
    taken = {"shard", "slot"}.intersection(docs.columns)
    if taken:
        raise ValueError(f"the table already has columns {sorted(taken)}")
    placed = assign_shards(docs, shards, key, id_col, text_col)
    ranked = Window.partitionBy("doc_id", "text_crc32").orderBy("slot", "shard")
    placed = placed.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot", F.row_number().over(ranked).alias("_place"))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), crc.alias("crc"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("id", "crc").orderBy(F.lit(0))))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("crc") == F.col("_crc")) & (F.col("place") == F.col("_place"))
    whole = rows.join(placed.hint("merge"), same).select("row.*", "shard", "slot").withColumn("_file", F.expr(f"slot div {file_rows}"))
    whole.repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)
