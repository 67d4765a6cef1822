"""Repeated byte strings across a corpus, by bucket refinement of string starts.

Every string of ``length`` bytes is known by its anchor: the gram inside it with the
smallest hash. Anchors with equal grams are the initial buckets. A bucket is refined on
identifiers of wider extents around its members: where all that surrounds a member
recurs, all strings of that anchor do; what differs is cut into blocks of starts, whose
buckets (by the bytes that all strings of the block share) are refined in the same
manner, down to single strings. Members of buckets of one end at once, so only starts
near the edges of repeated passages are ever looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import gram_order, mix, prefix_hash, release, slices, span_hash, text_bytes, written

GRAM = 33
_PLACE = np.uint64((1 << 22) - 1)
#: Starts that are handled at once: a longer text is cut, with what the strings at the cut reach over.
_SEGMENT = 1 << 20


def _runs(data: np.ndarray, ends: np.ndarray, count: int, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of the strings at the first ``count`` starts: (place, first start, last start).

    ``ends`` gives the end of each start's row. The anchor of a string is the leftmost of
    its GRAM-byte grams with the smallest hash, so equal strings have theirs at one place.
    """
    width, n = length - GRAM + 1, len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    grams = np.full(-(-(n + width) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    grams[: n - GRAM + 1] = (gram_order(data, GRAM) & ~_PLACE) | np.arange(n - GRAM + 1, dtype=np.uint64)
    blocks = grams.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(np.arange(count) + length <= ends)
    place = (np.minimum(behind[starts], ahead[starts + width - 1]) & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return place[first], starts[first], starts[np.append(first[1:], len(starts)) - 1] if len(starts) else first


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, segment: int = _SEGMENT) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of ``length`` bytes: (row, place, first start, last start, gram, extent).

    ``gram`` and ``extent`` are hashes of the anchor's gram and of all bytes that its
    strings may touch. Long texts are handled ``segment`` starts at a time; the strings of
    one anchor that a cut parts are put together again.
    """
    reach, n, parts = length - GRAM, len(data), []
    for at in range(0, n, segment):
        end = min(at + segment, n)
        one, last = np.searchsorted(offsets, (at, end - 1), "right") - 1
        low, high = offsets[one : last + 1], offsets[one + 1 : last + 2]
        ends = np.repeat(high - at, np.minimum(high, end) - np.maximum(low, at))
        p, s0, s1 = (x + at for x in _runs(data[at : end + length - 1], ends, end - at, length))
        low = max(at - reach, 0)
        sums = prefix_hash(data[low : end + 2 * length])
        row = np.searchsorted(offsets, p, "right") - 1
        around = _extent(sums, p - reach - low, p + length - low, offsets[row] - low, offsets[row + 1] - low)
        parts.append((row, p, s0, s1, span_hash(sums, p - low, p - low + GRAM), around))
    if not parts:
        return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    row, p, s0, s1, gram, around = (np.concatenate(x) for x in zip(*parts, strict=True))
    joins = (p[1:] == p[:-1]) & (s0[1:] == s1[:-1] + 1)
    first, last = np.append(True, ~joins)[: len(p)], np.append(~joins, True)[: len(p)]
    return row[first], p[first], s0[first], s1[last], gram[first], around[first]


def _extent(sums: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end as far as they lie in low..high, and of how much is cut off."""
    a, b = np.maximum(start, low), np.minimum(end, high)
    return mix(span_hash(sums, a, b) + mix(((a - start) * 4096 + (end - b)).astype(np.uint64)))


def _starts(docs: DataFrame, length: int) -> DataFrame:
    """Anchors of every text: text_key, gram, extent, place p and the starts s0..s1 that it stands for.

    Copies beyond the second of a task are left out: two tell that all their strings recur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in slices(batches, "text"):
            if len(seen) > 1_000_000:  # forgetting only means that more copies are looked at
                seen.clear()
            wanted = []
            for key in batch.column("text_key").to_pylist():
                seen[key] = seen.get(key, 0) + 1
                wanted.append(seen[key] <= 2)
            batch = batch.filter(pa.array(wanted, pa.bool_()))
            if batch.num_rows == 0:
                continue
            data, offsets = text_bytes(batch.column("text"))
            row, p, s0, s1, gram, around = anchors(data, offsets, length)
            keys = batch.column("text_key").take(pa.array(row))
            places = [pa.array((x - offsets[row]).astype(np.int32)) for x in (p, s0, s1)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), *places], ["text_key", "bucket", "extent", "p", "s0", "s1"])

    return docs.select("text_key", "text").mapInArrow(run, "text_key long, bucket long, extent long, p int, s0 int, s1 int")


def _refined(rows: DataFrame, members: list[str]) -> tuple[DataFrame, DataFrame]:
    """Members all of whose strings recur, and one member of each extent of the buckets that are still open.

    ``rows`` has bucket, extent, weight (occurrences a row stands for) and ``members``.
    Counts are aggregated before they are joined, and are written first: a join of plain
    tables is one that Spark splits, so that a bucket of any size is dealt with.
    """
    spark = rows.sparkSession
    sizes = written(rows.groupBy("bucket").agg(F.sum("weight").alias("_n")).where("_n >= 2").select("bucket"), "sizes")
    live = written(rows.join(sizes.hint("merge"), "bucket"), "live")
    release(spark)
    groups = live.groupBy("bucket", "extent").agg(F.sum("weight").alias("_c"), F.min(F.struct(*members)).alias("_one"))
    groups = written(groups, "groups")
    twice = groups.where("_c >= 2").select("bucket", "extent")
    recurring = live.join(twice.hint("merge"), ["bucket", "extent"]).select(*members)
    still = groups.groupBy("bucket").agg(F.count("*").alias("_k"), F.sum(F.when(F.col("_c") == 1, 1).otherwise(0)).alias("_alone"))
    still = written(still.where("_k >= 2 AND _alone > 0").select("bucket"), "still")
    left = groups.join(still.hint("merge"), "bucket").select("_one.*", F.least("_c", F.lit(2)).cast("int").alias("weight"))
    return recurring, left


def _contexts(texts: DataFrame, left: DataFrame, length: int) -> DataFrame:
    """Bytes around the anchors in ``left``: everything that any of their strings touches."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            found = batch.column("places")
            row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            flat = found.flatten()
            p, s0, s1, weight = (flat.field(k).to_numpy() for k in ("p", "s0", "s1", "weight"))
            a = np.maximum(p - reach, 0) + offsets[row]
            b = np.minimum(p + length + offsets[row], offsets[row + 1])
            raw = data.tobytes()
            context = pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
            at = np.minimum(p, reach)
            columns = [batch.column("text_key").take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (p, at, p - s1, p - s0, weight)), context]
            yield pa.RecordBatch.from_arrays(columns, ["text_key", "p", "at", "low", "high", "weight", "context"])

    places = left.groupBy("text_key").agg(F.collect_list(F.struct("p", "s0", "s1", "weight")).alias("places"))
    one_each = texts.groupBy("text_key").agg(F.first("text").alias("text"))
    joined = one_each.join(places.hint("merge"), "text_key").select("text_key", "text", "places")
    return joined.mapInArrow(run, "text_key long, p int, at int, low int, high int, weight int, context binary")


def _blocks(contexts: DataFrame, length: int, block: int) -> DataFrame:
    """Blocks of ``block`` starts of each context: bucket by the bytes common to their strings, extent by all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "context"):
            data, offsets = text_bytes(batch.column("context"))
            sums = prefix_hash(data)
            at, low, high = (batch.column(k).to_numpy().astype(np.int64) for k in ("at", "low", "high"))
            first = low // block
            n = high // block - first + 1
            row = np.repeat(np.arange(batch.num_rows), n)
            b = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
            near, far = b * block, b * block + block - 1
            here = offsets[row] + at[row]
            bucket = mix(span_hash(sums, here - near, here - far + length) + b.astype(np.uint64))
            extent = _extent(sums, here - far, here - near + length, offsets[row], offsets[row + 1])
            lo, hi = np.maximum(near, low[row]), np.minimum(far, high[row])
            take = pa.array(row)
            columns = [batch.column("text_key").take(take), batch.column("p").take(take), *(pa.array(x.astype(np.int32)) for x in (lo, hi)), batch.column("weight").take(take)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bucket.view(np.int64)), pa.array(extent.view(np.int64))], ["text_key", "p", "low", "high", "weight", "bucket", "extent"])

    return contexts.mapInArrow(run, "text_key long, p int, low int, high int, weight int, bucket long, extent long")


def _strings(contexts: DataFrame, left: DataFrame, length: int) -> DataFrame:
    """Every single string of the blocks in ``left``: text_key, start s, weight and bucket (its hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "context"):
            data, offsets = text_bytes(batch.column("context"))
            sums = prefix_hash(data)
            found = batch.column("blocks")
            row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            flat = found.flatten()
            low, high, weight = (flat.field(k).to_numpy().astype(np.int64) for k in ("low", "high", "weight"))
            n = high - low + 1
            of = np.repeat(np.arange(len(n)), n)
            o = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]
            row = row[of]
            start = offsets[row] + batch.column("at").to_numpy()[row] - o
            bucket = span_hash(sums, start, start + length)
            s = batch.column("p").to_numpy()[row] - o
            columns = [batch.column("text_key").take(pa.array(row)), pa.array(s.astype(np.int32)), pa.array(weight[of].astype(np.int32)), pa.array(bucket.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["text_key", "s", "weight", "bucket"])

    blocks = left.groupBy("text_key", "p").agg(F.collect_list(F.struct("low", "high", "weight")).alias("blocks"))
    joined = contexts.select("text_key", "p", "at", "context").join(blocks.hint("merge"), ["text_key", "p"])
    return joined.mapInArrow(run, "text_key long, s int, weight int, bucket long")


def repeated_spans(texts: DataFrame, length: int = 200, block: int = 12) -> DataFrame:
    """(text_key, spans): the byte spans of each text covered by recurring strings, not yet merged.

    ``texts`` has text_key and text, one row per document, copies included.
    """
    spark = texts.sparkSession
    alike, left = _refined(_starts(texts, length).withColumn("weight", F.lit(1)), ["text_key", "p", "s0", "s1"])
    contexts = written(_contexts(texts, left, length), "contexts")
    release(spark)
    alike_blocks, left = _refined(_blocks(contexts, length, block), ["text_key", "p", "low", "high"])
    strings = _strings(contexts, left, length)
    twice = strings.groupBy("bucket").agg(F.sum("weight").alias("_n")).where("_n >= 2").select("bucket")
    single = strings.join(twice.hint("merge"), "bucket")
    spans = (
        alike.select("text_key", F.col("s0").alias("start"), (F.col("s1") + length).alias("end"))
        .unionByName(alike_blocks.select("text_key", (F.col("p") - F.col("high")).alias("start"), (F.col("p") - F.col("low") + length).alias("end")))
        .unionByName(single.select("text_key", F.col("s").alias("start"), (F.col("s") + length).alias("end")))
    )
    out = written(spans.groupBy("text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    release(spark)
    return out


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals, row by row; those of a row lie beyond those of the rows before."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1] if len(start) else end


def _covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n bytes lie in the runs, which do not overlap."""
    change = np.zeros(n + 1, np.int8)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    return np.cumsum(change[:-1], dtype=np.int8) > 0


def remove_repeats(docs: DataFrame, length: int = 200, text_col: str = "text", as_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with n_bytes, spans (merged, removed), and kept (the remaining bytes).

    ``row`` is a struct of all columns but the text. With ``as_text`` kept is a string,
    without the bytes of characters that were removed in part.

    A byte is removed if it lies in a string of ``length`` bytes that starts anywhere
    else too, in the same text or another row's; strings are judged on the input. Null
    texts count as empty, a text of any length is taken whole (long ones a segment at a
    time), and ``length`` may be up to 4,096 bytes. Texts shorter than ``length`` are kept whole; copies of longer
    ones are removed whole. Null ids, empty tables and further columns (kept as they
    are, even named like the new ones of this table's inner steps) are fine.

    Strings are told apart by 64-bit hashes and texts by the 64-bit hash of the text.
    """
    if not GRAM <= length <= 4096:
        raise ValueError(f"length must be from {GRAM} to 4096")
    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    spans = repeated_spans(texts, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            found = batch.column("spans")
            count = np.where(found.is_valid().to_numpy(zero_copy_only=False), np.diff(found.offsets.to_numpy()), 0)
            row = np.repeat(np.arange(batch.num_rows), count)
            flat = found.flatten()
            first, last = _merged(row, flat.field("start").to_numpy() + offsets[row], flat.field("end").to_numpy() + offsets[row])
            gone = _covered(first, last, len(data))
            row = np.searchsorted(offsets, first, "right") - 1
            runs = pa.StructArray.from_arrays([pa.array((x - offsets[row]).astype(np.int32)) for x in (first, last)], ["start", "end"])
            merged = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, offsets), pa.int32()), runs)
            removed = np.concatenate([[0], np.cumsum(last - first)])
            at = offsets - removed[np.searchsorted(first, offsets)]
            rest = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[~gone])])
            kept = pa.array([x.decode("utf-8", "ignore") for x in rest.to_pylist()], pa.string()) if as_text else rest
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(offsets)), merged, kept], ["row", "n_bytes", "spans", "kept"])

    fields = [f for f in docs.schema if f.name != text_col]
    row = F.struct(*[F.col(f"`{f.name}`") for f in fields])
    kind = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)
    keyed = docs.select(row.alias("row"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    joined = keyed.join(spans.hint("merge"), "text_key", "left").select("row", "text", "spans")
    return joined.mapInArrow(cut, f"row struct<{kind}>, n_bytes long, spans array<struct<start: int, end: int>>, kept {'string' if as_text else 'binary'}")
