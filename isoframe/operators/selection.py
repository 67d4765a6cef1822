"""Selections that depend on what is already selected: in rounds over the table, long chains component by component."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from isoframe.operators.components import connected
from isoframe.operators.running import first_of_group


def greedy(rows: DataFrame, order: list, caps: dict[str, int], store: Callable[[DataFrame, str], DataFrame], rounds: int = 6) -> DataFrame:
    """Rows with ``reason`` (null: accepted; else the key whose cap was full), as if they were taken one by one in ``order``.

    At most ``caps[key]`` rows of one value of each key are accepted (null is a value), and
    a row that is held back uses up nothing. Each of up to ``rounds`` rounds accepts the
    rows that rank within all their caps among those still open, and holds back those whose cap is
    full; that settles most tables. What is left hangs together in long chains, of which a
    round would settle little more than one row: those are taken one by one, every connected
    component by itself (see ``_one_by_one``). ``order`` must not have ties.
    """
    open_ = store(rows.withColumn("_order", F.struct(*order)), "open")
    keys = list(caps)
    done = None
    for _ in range(rounds):
        ranked = _with_taken(open_, done, caps)
        for key in keys:
            rank = F.row_number().over(Window.partitionBy(key).orderBy("_order"))
            ranked = ranked.withColumn(f"_fits_{key}", rank + F.col(f"_taken_{key}") <= caps[key])
        full = _first_full(caps, lambda key: F.col(f"_taken_{key}") >= caps[key])
        fits = F.lit(True)
        for key in keys:
            fits = fits & F.col(f"_fits_{key}")
        judged = store(ranked.select("*", F.when(full.isNotNull(), full).when(fits, "").alias("_said")).select(*open_.columns, "_said"), "judged")
        settled = judged.where("_said IS NOT NULL").withColumn("reason", F.nullif("_said", F.lit(""))).drop("_said")
        done = store(settled if done is None else done.unionByName(settled), "done")
        open_ = judged.where("_said IS NULL").drop("_said")
        if open_.isEmpty():
            return _with_reasons(done, caps).drop("_order")
    rest = _one_by_one(_with_taken(open_, done, caps), caps, store)
    return _with_reasons(store(done.unionByName(rest.select(*done.columns)), "done"), caps).drop("_order")


def _first_full(caps: dict[str, int], full: Callable[[str], Column]) -> Column:
    said = F.lit(None).cast("string")
    for key in reversed(list(caps)):
        said = F.when(full(key), key).otherwise(said)
    return said


def _node(key: str) -> Column:
    """A value of a key as text; null is told from the empty text."""
    return F.concat(F.lit(f"{key}:"), F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))


def _one_by_one(rows: DataFrame, caps: dict[str, int], store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rows (with _taken_ counts) with their reason, taken in order within each component of rows that share values.

    Rows of different components share no value, so components are independent. A task
    reads its components' rows in order and holds counts of the current one's values.
    """
    keys = list(caps)
    linked = rows.select(F.explode(F.array(*[F.struct(_node(keys[0]).alias("a"), _node(k).alias("b")) for k in keys[1:] or keys])).alias("e")).select("e.*")
    roots = connected(store(linked, "links"), store)
    placed = rows.withColumn("_node", _node(keys[0])).join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")).hint("merge"), "_node").drop("_node")
    nodes = F.array(*[_node(k) for k in keys])
    placed = placed.withColumn("_nodes", nodes).withColumn("_counts", F.array(*[F.col(f"_taken_{k}").cast("long") for k in keys]))
    limits = list(caps.values())

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh, last = first_of_group(batch, ["_root"], last)
            reasons = []
            for new, names, counts in zip(fresh.tolist(), batch.column("_nodes").to_pylist(), batch.column("_counts").to_pylist(), strict=True):
                if new:
                    taken = {}
                for name, count in zip(names, counts, strict=True):
                    taken.setdefault(name, count)
                full = next((k for k, name, limit in zip(keys, names, limits, strict=True) if taken[name] >= limit), None)
                if full is None:
                    for name in names:
                        taken[name] += 1
                reasons.append(full)
            yield batch.append_column("reason", pa.array(reasons, pa.string()))

    ordered = placed.repartition("_root").sortWithinPartitions("_root", "_order")
    return ordered.mapInArrow(take, StructType([*ordered.schema, StructField("reason", StringType())]))


def _with_reasons(done: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The key whose cap was full when it was the row's turn, in order of ``caps``."""
    said = F.lit(None).cast("string")
    for key, cap in reversed(caps.items()):
        before = Window.partitionBy(key).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
        done = done.withColumn(f"_before_{key}", F.coalesce(F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)).over(before), F.lit(0)))
        said = F.when(F.col(f"_before_{key}") >= cap, key).otherwise(said)
    return done.withColumn("reason", F.when(F.col("reason").isNotNull(), said)).drop(*[f"_before_{key}" for key in caps])


def _with_taken(rows: DataFrame, done: DataFrame | None, caps: dict[str, int]) -> DataFrame:
    """Add ``_taken_{key}``: accepted rows of the row's value of each key."""
    for key in caps:
        if done is None:
            rows = rows.withColumn(f"_taken_{key}", F.lit(0).cast("long"))
            continue
        taken = done.where("reason IS NULL").groupBy(F.col(key).alias("_key")).agg(F.count("*").alias(f"_taken_{key}"))
        joined = rows.join(taken.hint("merge"), rows[key].eqNullSafe(F.col("_key")), "left").drop("_key")
        rows = joined.withColumn(f"_taken_{key}", F.coalesce(f"_taken_{key}", F.lit(0)))
    return rows


def shortlist(rows: DataFrame, caps: dict[str, int], total: int | None, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rows with ``reason``: null for the shortlist, else the cap that holds them back; more bases first, then the smaller id."""
    order = [(-F.coalesce("bases", F.lit(0))).alias("a"), F.col("sample_id").alias("b")]
    out = greedy(rows, order, caps, store)
    if total is None:
        return out
    first = out.where("reason IS NULL").orderBy(*order).limit(total).select("sample_id", F.lit(True).alias("_in"))
    joined = out.join(first.hint("merge"), "sample_id", "left")
    return joined.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_in").isNull(), "total").otherwise(F.col("reason"))).drop("_in")


def independent(rows: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """One isolate per cluster and per (site, patient), by id order; rows without these are an error."""
    filled = F.lit(True)
    for c in ("cluster_id", "patient_id", "site_id"):
        filled = filled & (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    checked = rows.withColumn("patient", F.when(filled, F.concat_ws("|", "site_id", "patient_id")).otherwise(F.raise_error(F.lit("cluster, patient and site are required")).cast("string")))
    return greedy(checked, [F.col("isolate_id").alias("a")], {"cluster_id": 1, "patient": 1}, store)


def crossing_groups(rows: DataFrame) -> DataFrame:
    """Clusters and patients (within a site) that occur in more than one partition."""
    groups = F.explode(F.array(
        F.struct(F.lit("cluster").alias("kind"), F.col("cluster_id").cast("string").alias("group")), F.struct(F.lit("patient").alias("kind"), F.concat_ws("|", F.col("site_id").cast("string"), F.col("patient_id").cast("string")).alias("group")),
    ))
    told = rows.where("partition IS NOT NULL").select(groups.alias("_g"), "partition").select("_g.*", "partition")
    return told.groupBy("kind", "group").agg(F.count_distinct("partition").alias("n_partitions")).where("n_partitions > 1")


def top_per_key(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def first_eligible(rows: DataFrame, eligible: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in order that are eligible; others use up nothing."""
    return rows.where(eligible).orderBy(order).limit(n)
