"""Helpers shared by the text operators: scratch tables, Arrow slices, word hashing."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed byte sets of the word contracts: ASCII white space, and ASCII outside 0-9 a-z.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_GOLDEN = 0x9E3779B97F4A7C15
#: Hashes of spans are polynomials over the field of this Mersenne prime, at a base drawn once.
_PRIME = np.uint64(2**61 - 1)
_BASE = 0x16E8FEB86659FD93
_LOW29, _LOW30, _LOW31, _LOW32 = (np.uint64(2**k - 1) for k in (29, 30, 31, 32))
_BYTE_CODE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**61 - 1, 256, dtype=np.uint64)
_PLACE_BYTE = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64 - 1, 64 * 256, dtype=np.uint64)
_wrapped = {"up": np.ones(0, np.uint64), "down": np.ones(0, np.uint64)}
_powers = {"n": 0, "up": np.ones(0, np.uint64), "down": np.ones(0, np.uint64)}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this session. Where none is named a session on one machine gets a local one; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            folder = f"file:///tmp/isoframe-{uuid.uuid4().hex}"
            spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/isoframe"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table in the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished stages, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or with a dotted name a field of a struct column."""
    first, *rest = name.split(".", 1)
    column = batch.column(first)
    return column.field(rest[0]) if rest else column


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each holds at most ``limit`` bytes, or one row.

    Word and byte statistics take about a hundred bytes of memory for each byte of a slice.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(field(batch, column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string (or binary) column laid end to end, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more at the end)."""
    gap = separators[data]
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    inner = offsets[1:][offsets[1:] > 0]
    after[inner - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection, so distinct values stay distinct)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo the prime."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _product(x: np.ndarray, y: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """Products modulo the prime of values below it; blocks keep what is in work in the processor's cache."""
    out = np.empty(len(x), np.uint64)
    for at in range(0, len(x), block):
        a, b = x[at : at + block], y[at : at + block]
        ah, bh = a >> np.uint64(31), b >> np.uint64(31)
        al, bl = a & _LOW31, b & _LOW31
        mid = al * bh
        mid += ah * bl
        al *= bl
        ah *= bh
        ah <<= np.uint64(1)
        al += ah
        al += mid >> np.uint64(30)
        mid &= _LOW30
        mid <<= np.uint64(31)
        al += mid
        top = al >> np.uint64(61)
        al &= _PRIME
        al += top
        al -= np.where(al >= _PRIME, _PRIME, np.uint64(0))
        out[at : at + block] = al
    return out


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    at = 1
    while at < n:  # each pass doubles what is filled
        out[at : 2 * at] = _product(out[: min(at, n - at)], np.full(min(at, n - at), pow(base, at, int(_PRIME)), np.uint64))
        at *= 2
    return out


def _grown(n: int) -> None:
    if _powers["n"] < n:
        size = max(n, 1 << 20)
        _powers.update(n=size, up=_powers_of(_BASE, size), down=_powers_of(pow(_BASE, -1, int(_PRIME)), size))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums S with which ``span_hash`` hashes any span of the bytes in constant time."""
    _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    block, last = 1 << 13, np.uint64(0)
    for at in range(0, len(data), block):
        terms = _product(_BYTE_CODE[data[at : at + block]], _powers["up"][at : min(at + block, len(data))])
        high = np.cumsum(terms >> np.uint64(32))  # halves of the terms, so that no sum leaves 64 bits
        low = np.cumsum(terms & _LOW32)
        # high * 2**32 modulo 2**61 - 1: its bits from the 29th on come round to the lowest.
        whole = ((high & _LOW29) << np.uint64(32)) + (high >> np.uint64(29)) + low + last
        sums[at + 1 : at + 1 + len(terms)] = _reduced(whole)
        last = sums[at + len(terms)]
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: equal bytes give equal values wherever they stand.

    Different spans of n bytes agree for at most n of the 2**61 possible bases.
    """
    raw = _product(_reduced(sums[ends] + (_PRIME - sums[starts])), _powers["down"][starts])
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_GOLDEN))


def gram_order(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit number for the ``width`` bytes from each place on, the same for equal bytes wherever they stand.

    It only puts grams in an order, so it is a polynomial modulo 2**64, which is cheaper
    than ``span_hash``: different grams may share a number.
    """
    n = max(len(data) - width + 1, 0)
    if len(_wrapped["up"]) < len(data):
        size = max(len(data), 1 << 20)
        for way, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            powers = np.full(size, factor, np.uint64)
            powers[0] = 1
            _wrapped[way] = np.multiply.accumulate(powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _wrapped["up"][: len(data)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * _wrapped["down"][:n])


def apart_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans that are not empty; cheaper than ``span_hash`` where spans do not overlap.

    The sum of one random value for each place and byte, from a table up to place 64 and
    mixed from it beyond.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    at = np.cumsum(size) - size
    total = int(size.sum())
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    place = np.arange(total, dtype=kind)
    if total == ends[-1] - starts[0]:  # spans one after another
        value = data[starts[0] : ends[-1]].astype(np.int32)
    else:
        value = data[place + np.repeat((starts - at).astype(kind), size)].astype(np.int32)
    place -= np.repeat(at.astype(kind), size)
    value += (place & 63).astype(np.int32) << 8
    terms = _PLACE_BYTE[value]
    far = np.flatnonzero(place >= 64)
    if len(far):
        terms[far] = mix(terms[far] + (place[far] >> 6).astype(np.uint64) * np.uint64(_GOLDEN))
    return mix(np.add.reduceat(terms, at) + size.astype(np.uint64) * np.uint64(_GOLDEN))


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether span k of ``data`` holds the same bytes as span k of ``others``."""
    size = ends - starts
    out = size == other_ends - other_starts
    long = np.flatnonzero(out & (size > 0))
    if len(long):
        n = size[long]
        at = np.cumsum(n) - n
        kind = np.int32 if max(len(data), len(others)) < 1 << 31 else np.int64
        step = np.arange(int(n.sum()), dtype=kind)
        if len(step) == ends[long[-1]] - starts[long[0]]:
            here = data[starts[long[0]] : ends[long[-1]]]
        else:
            here = data[step + np.repeat((starts[long] - at).astype(kind), n)]
        step += np.repeat((other_starts[long] - at).astype(kind), n)
        differ = np.flatnonzero(here != others[step])
        out[long[np.searchsorted(at, differ, "right") - 1]] = False
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the word offsets of the rows."""
    starts, ends, firsts = word_spans(data, offsets, separators)
    return apart_hash(data, starts, ends), firsts


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words (len(words) - width + 1 values)."""
    n = max(len(words) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(_GOLDEN) + words[k : k + n] + np.uint64(k + 1))
    return out


COUNTS = "part int, counts binary"


def count_rows(counts: np.ndarray, parts: int = 16) -> pa.RecordBatch:
    """A fixed-size count vector as ``parts`` rows of the schema COUNTS."""
    blobs = [x.astype(np.int64).tobytes() for x in np.array_split(counts, parts)]
    return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], ["part", "counts"])


def summed_counts(rows: DataFrame, parts: int = 16, fan: int = 64) -> np.ndarray:
    """The sum of count vectors, of which every task gave one. Its length is fixed by a parameter, not by the data.

    Vectors are added in two steps, the first in up to ``fan`` tasks for each part, so
    that no task adds those of all tasks.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(blob, np.int64)
                total[part] = total[part] + x if part in total else x
        if total:
            blobs = [x.tobytes() for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(blobs, pa.binary())], ["part", "counts"])

    few = rows.withColumn("_fan", F.spark_partition_id() % fan).repartition(parts * fan, "part", "_fan").drop("_fan").mapInArrow(add, COUNTS)
    found = few.repartition(parts, "part").mapInArrow(add, COUNTS).collect()
    return np.concatenate([np.frombuffer(r.counts, np.int64) for r in sorted(found, key=lambda r: r.part)] or [np.zeros(0, np.int64)])
