"""Running sums and finite-state scans of keys of any size: each key's rows are cut into ranges that many tasks share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_of(df: DataFrame, order: str, ranges: int = 64) -> Column:
    """The number of the range that a row's ``order`` lies in: ranges of about equal numbers of rows, whatever their keys.

    Rows of equal order share a range. The bounds are at most ``ranges`` numbers, found
    by an approximate pass; any bounds give the same results. Null order is range -1.
    """
    bounds = df.agg(F.percentile_approx(F.col(order).cast("double"), [k / ranges for k in range(1, ranges)], 1000)).first()[0] or []
    held = F.lit(sorted(set(bounds))).cast("array<double>")
    return F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter(held, lambda b: b < F.col(order).cast("double")))).cast("int")


def running_sums(df: DataFrame, keys: list[str], order: str, columns: list[str], ranges: int = 64) -> DataFrame:
    """Add ``{c}_before``, the sum of a column over the key's rows of smaller ``order``, and ``{c}_total``.

    Orders must be distinct within a key, keys may be null. A window runs over one range of a
    key, and only the sums of ranges meet per key, so a key of any size is shared out.
    """
    ranged = df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0))).withColumn("_range", range_of(df, order, ranges))
    sums = ranged.groupBy("_key", "_range").agg(*[F.sum(c).alias(c) for c in columns])
    whole = Window.partitionBy("_key")
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_earlier_{c}") for c in columns], *[F.sum(c).over(whole).alias(f"{c}_total") for c in columns])
    inside = Window.partitionBy("_key", "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"_inside_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}).join(sums.hint("merge"), ["_key", "_range"])
    before = [(F.col(f"_earlier_{c}") + F.col(f"_inside_{c}")).alias(f"{c}_before") for c in columns]
    return out.select(*df.columns, *before, *[f"{c}_total" for c in columns])


def first_of_group(batch: pa.RecordBatch, columns: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Which rows of a sorted batch begin a group of equal columns, after the last row of the batch before."""
    fresh = np.zeros(batch.num_rows, bool)
    for c in columns:
        codes = pc.fill_null(batch.column(c).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        fresh[1:] |= codes[1:] != codes[:-1]
    here = lambda k: tuple(batch.column(c)[k].as_py() for c in columns)
    fresh[0] = last is None or here(0) != last
    return fresh, here(batch.num_rows - 1)


def composed(tables: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Inclusive scan: row k becomes the composition of its group's functions up to k.

    ``tables[k, s]`` is the state that step k leads to from state s. Steps are composed in
    pairs, then fours and so on, all groups at once.
    """
    out, closed, step = tables.copy(), fresh.copy(), 1
    closed[0] = True
    while step < len(out) and not closed.all():
        joined = np.take_along_axis(out[step:], out[:-step], axis=1)
        free = ~closed[step:]
        after = closed.copy()
        after[step:] |= closed[:-step]
        out[step:][free] = joined[free]
        closed, step = after, 2 * step
    return out


def scan_states(moves: DataFrame, key: str, order: list[str], table: np.ndarray, start: int, code: str = "code", ranges: int = 64) -> DataFrame:
    """Add ``before``: the state of the key before each row, where row by row ``table[code, state]`` is the next state.

    Rows of a key are taken in ``order`` (its first column is numeric and cuts them into ranges). A first pass composes
    the functions of each range, a second carries the states over the ranges of a key,
    a third runs through each range from its state. No task holds a key, only a batch.
    """
    ranged = moves.withColumn("_range", range_of(moves, order[0], ranges)).withColumn("_known", F.lit(None).cast("int"))
    kind = {f.name: f.dataType.simpleString() for f in ranged.schema}
    size = table.shape[1]

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held = group = None
        for batch in batches:
            if not batch.num_rows:
                continue
            steps = table[batch.column(code).to_numpy()]
            fresh, now = first_of_group(batch, [key, "_range"], last)
            if not fresh[0]:
                steps[0] = steps[0][held]
            elif last is not None:
                yield told(group, held[None])
            done = composed(steps, fresh)
            ends = np.flatnonzero(fresh[1:])
            if len(ends):
                yield told(batch.take(pa.array(ends)), done[ends])
            last, held, group = now, done[-1], batch.slice(batch.num_rows - 1)
        if last is not None:
            yield told(group, held[None])

    def told(groups: pa.RecordBatch, effect: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([groups.column(key), groups.column("_range"), pa.array(effect.tolist(), pa.list_(pa.int32()))], [key, "_range", "_effect"])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh, last = first_of_group(batch, [key], last)
            before = states_before(np.array(batch.column("_effect").to_pylist(), np.int64).reshape(-1, size), fresh, np.full(batch.num_rows, start), state)
            state = int(before[-1])
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("_range"), pa.array(before[:-1].astype(np.int32))], [key, "_range", "_known"])

    def states_before(steps: np.ndarray, fresh: np.ndarray, begun: np.ndarray, state: int) -> np.ndarray:
        """States before each step and after the last; ``begun`` are those at the first step of a group."""
        steps = steps.copy()
        rows = np.flatnonzero(fresh)
        steps[rows] = steps[rows, begun[rows]][:, None]
        if not fresh[0]:
            steps[0] = steps[0, state]
        after = composed(steps, fresh)[:, 0]
        before = np.append(state, after)
        before[:-1][fresh] = begun[fresh]
        return before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for batch in batches:
            if not batch.num_rows:
                continue
            known = pc.fill_null(batch.column("_known"), -1).to_numpy(zero_copy_only=False)
            mark = known >= 0  # a row that only tells the state at the head of its range
            steps = np.where(mark[:, None], np.maximum(known, 0)[:, None], table[np.where(mark, 0, batch.column(code).fill_null(0).to_numpy(zero_copy_only=False))])
            before = states_before(steps, mark, np.maximum(known, 0), state)
            state = int(before[-1])
            at = batch.schema.get_field_index("_known")
            yield batch.set_column(at, "_known", pa.array(before[:-1].astype(np.int32))).filter(pa.array(~mark))

    first = ranged.repartition(key, "_range").sortWithinPartitions(key, "_range", *order)
    effect = first.select(key, "_range", code).mapInArrow(effects, f"`{key}` {kind[key]}, _range int, _effect array<int>")
    heads = effect.repartition(key).sortWithinPartitions(key, "_range").mapInArrow(carried, f"`{key}` {kind[key]}, _range int, _known int")
    both = ranged.unionByName(heads, allowMissingColumns=True)
    placed = both.repartition(key, "_range").sortWithinPartitions(key, "_range", F.col("_known").isNull(), *order)
    return placed.mapInArrow(run, both.schema).withColumnRenamed("_known", "before").drop("_range")
