"""Variant text as a data source: planned splits, block-compressed files cut between blocks, records filtered by position.

Most records of a file stand at positions that no catalogue names. The reader finds the
first tabs of many lines at once and hands on only lines that can matter, as Arrow
batches, so nothing else of a line is looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from isoframe.sources.scratch import shared_path

RECORDS = "file string, value string, contig string, pos long, ref string"
_SCHEMA = pa.schema([("file", pa.string()), ("value", pa.string()), ("contig", pa.string()), ("pos", pa.int64()), ("ref", pa.string())])
#: Fixed by the format: how a block of a block-compressed file begins, and the longest block.
_BLOCK_HEAD, _BLOCK_LONGEST = b"\x1f\x8b\x08\x04", 1 << 16
_CHUNK = 4 << 20


@dataclass
class Split(InputPartition):
    """Bytes start..end of a file; kind is plain, gzip (one split) or blocks."""

    file: str
    path: str
    kind: str
    start: int
    end: int


def block_size(head: bytes) -> int:
    """Bytes of the block that begins here, 0 if none does: a gzip member with a BC field that holds its size."""
    if len(head) < 18 or head[:4] != _BLOCK_HEAD:
        return 0
    extra = 12 + struct.unpack("<H", head[10:12])[0]
    at = 12
    while at + 4 <= min(extra, len(head)):
        name, size = head[at : at + 2], struct.unpack("<H", head[at + 2 : at + 4])[0]
        if name == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack("<H", head[at + 4 : at + 6])[0] + 1
        at += 4 + size
    return 0


def _first_block(handle, start: int, length: int) -> int:
    """The first place from ``start`` on where a block begins; a block is believed if another, or the end, follows it."""
    handle.seek(start)
    data = handle.read(2 * _BLOCK_LONGEST + 64)
    at = data.find(_BLOCK_HEAD)
    while at >= 0:
        size = block_size(data[at : at + 64])
        after = start + at + size
        if size and after == length:
            return start + at
        if size and after < length:
            handle.seek(after)
            if block_size(handle.read(64)):
                return start + at
        at = data.find(_BLOCK_HEAD, at + 1)
    return length


def _plain(handle, start: int) -> Iterator[tuple[int, bytes]]:
    handle.seek(start)
    while data := handle.read(_CHUNK):
        yield start, data
        start += len(data)


def _gzip(handle, start: int) -> Iterator[tuple[int, bytes]]:
    """The text of gzip members one after another; zero bytes after a member are padding."""
    stream, fresh = zlib.decompressobj(31), True
    while data := handle.read(_CHUNK // 4):
        while data:
            if fresh:
                data = data.lstrip(b"\0")
                if not data:
                    break
                fresh = False
            yield start, stream.decompress(data)
            data = stream.unused_data
            if stream.eof:
                stream, fresh = zlib.decompressobj(31), True
    if not fresh:
        raise ValueError("a compressed file ends within a member")


def _blocks(handle, start: int, length: int) -> Iterator[tuple[int, bytes]]:
    """The text of each block from ``start`` on, with the place where the block begins."""
    handle.seek(start)
    data, at = b"", 0
    while True:
        size = block_size(data[at : at + 64])
        if not size or at + size > len(data):
            more = handle.read(_CHUNK // 4)
            if not more:
                if at < len(data):
                    raise ValueError(f"no whole block at byte {start + at}")
                return
            start, data, at = start + at, data[at:] + more, 0
            continue
        yield start + at, zlib.decompress(data[at : at + size], 31)
        at += size


def _text(handle, split: Split, length: int) -> Iterator[bytes]:
    """The lines that begin in the split, in pieces that end with a line.

    As in every splittable text format, a split leaves out the line it begins within and
    reads on to the end of the line that is open where it ends; a line that begins right
    at the end of a split belongs to it, as the next one leaves it out.
    """
    start = _first_block(handle, split.start, length) if split.kind == "blocks" and split.start else split.start
    if start >= split.end:
        return
    pieces = {"plain": _plain, "gzip": _gzip}.get(split.kind)
    source = pieces(handle, start) if pieces else _blocks(handle, start, length)
    skipping, held, size = start > 0, [], 0
    for place, data in source:
        cut = 0
        if skipping:
            cut = data.find(b"\n") + 1
            if split.kind == "plain" and cut and place + cut > split.end or split.kind == "blocks" and place >= split.end:
                return
            if not cut:
                continue
            skipping = False
        beyond = max(split.end - place, 0) if split.kind == "plain" else 0 if split.kind == "blocks" and place >= split.end else len(data)
        if beyond < len(data) or split.kind == "plain" and place + len(data) > split.end:
            stop = data.find(b"\n", max(beyond, cut)) + 1
            if stop:
                held.append(data[cut:stop])
                break
        held.append(data[cut:])
        size += len(data)
        if size >= _CHUNK and b"\n" in data[cut:]:
            whole = b"".join(held)
            stop = whole.rfind(b"\n") + 1
            yield whole[:stop]
            held, size = [whole[stop:]], len(whole) - stop
    rest = b"".join(held)
    if rest:
        yield rest if rest.endswith(b"\n") else rest + b"\n"


def _numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that fields hold, and which fields are numbers; up to 18 digits at once, others one by one."""
    size = end - start
    value, good = np.zeros(len(start), np.int64), (size > 0) & (size <= 18)
    for k in range(int(size[good].max()) if good.any() else 0):
        inside = good & (size > k)
        digit = data[np.where(inside, start + k, 0)].astype(np.int64) - 0x30
        wrong = inside & ((digit < 0) | (digit > 9))
        good &= ~wrong
        value = np.where(inside & ~wrong, value * 10 + digit, value)
    for k in np.flatnonzero(~good & (size > 0)).tolist():
        text = data[start[k] : end[k]].tobytes().decode("utf-8", "replace").strip(" \t\r\x0b\x0c\x00")
        if text.lstrip("+-").isascii() and text.lstrip("+-").isdigit() and len(text) - len(text.lstrip("+-")) <= 1 and -(2**63) <= int(text) < 2**63:
            value[k], good[k] = int(text), True
    return value, good


def records(piece: bytes, file: str, wanted: np.ndarray | None) -> pa.RecordBatch | None:
    """Records among whole lines that reach one of the ``wanted`` positions (sorted; None: all records)."""
    data = np.frombuffer(piece, np.uint8)
    ends = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([[0], ends[:-1] + 1])
    tabs = np.flatnonzero(data == 0x09)
    first = np.searchsorted(tabs, starts)
    full = (data[starts] != 0x23) & (first + 2 < len(tabs))
    full[full] = tabs[first[full] + 2] < ends[full]
    starts, ends, first = starts[full], ends[full], first[full]
    ends = ends - ((ends > starts) & (data[ends - 1] == 0x0D))
    after = np.append(tabs, len(data))
    a, b, c, d = tabs[first], tabs[first + 1], tabs[first + 2], np.minimum(after[first + 3], ends)
    pos, good = _numbers(data, a + 1, b)
    if wanted is not None:
        k = np.searchsorted(wanted, pos)
        near = np.append(wanted, 0)[k]
        good &= (k < len(wanted)) & (near - pos < d - c - 1)
    keep = np.flatnonzero(good)
    if not len(keep):
        return None
    cut = lambda x, y: pa.array([piece[i:j].decode("utf-8", "replace") for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True)], pa.string())
    return pa.RecordBatch.from_arrays([pa.array([file] * len(keep), pa.string()), cut(starts, ends), cut(starts, a), pa.array(pos[keep]), cut(c + 1, d)], schema=_SCHEMA)


class VariantReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.kind = options.get("kind", "records")
        self.positions = options.get("positions")
        self.split_bytes = int(options.get("splitbytes", 64 << 20))

    def partitions(self) -> list[Split]:
        out = []
        for path in self.paths:
            store, root = fs.FileSystem.from_uri(path)
            info = store.get_file_info(root)
            found = store.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
            prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
            for f in found:
                if f.type == fs.FileType.NotFound:
                    raise FileNotFoundError(f.path)
                if f.type != fs.FileType.File or f.base_name.startswith(("_", ".")) or not f.size:
                    continue
                with store.open_input_file(f.path) as handle:
                    head = handle.read(64)
                kind = "blocks" if block_size(head) else "gzip" if head[:2] == b"\x1f\x8b" else "plain"
                step = f.size if kind == "gzip" or self.kind == "header" else self.split_bytes
                out += [Split(prefix + f.path, prefix + f.path, kind, at, min(at + step, f.size)) for at in range(0, f.size, step)]
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(split.path)
        wanted = None
        if self.positions:
            table_store, table = fs.FileSystem.from_uri(self.positions)
            wanted = np.unique(pq.read_table(table, columns=["pos"], filesystem=table_store).column("pos").drop_null().to_numpy())
        with store.open_input_file(path) as handle:
            length = handle.size()
            for piece in _text(handle, split, length):
                if self.kind == "header":
                    lines = [x for x in piece.decode("utf-8", "replace").splitlines() if x]
                    named = [x for x in lines if x.startswith("#CHROM")]
                    if named:
                        none = pa.nulls(len(named), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([split.file] * len(named)), pa.array(named), none, pa.nulls(len(named), pa.int64()), none], schema=_SCHEMA)
                    if any(not x.startswith("#") for x in lines):
                        return
                elif (batch := records(piece, split.file, wanted)) is not None:
                    yield batch


class VariantText(DataSource):
    """Options: paths (one a line), kind (records, or header for the column line only), positions (a Parquet table of pos), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "varianttext"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> VariantReader:
        return VariantReader(self.options)


def _loaded(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    spark.dataSource.register(VariantText)
    listed = [paths] if isinstance(paths, str) else paths
    whole = [p if "://" in p else f"file://{p.removeprefix('file:')}" for p in listed]
    return spark.read.format("varianttext").options(paths="\n".join(whole), **options).load()


def scan(spark: SparkSession, paths: str | list[str], positions: DataFrame | None = None, split_bytes: int = 64 << 20, most_positions: int = 20_000_000) -> DataFrame:
    """Records (columns of RECORDS) of files or folders of variant text; with ``positions`` only those that reach one of them.

    Plain files and files of gzip blocks with sizes (BGZF) are read in splits of about
    ``split_bytes``; any other gzip file is one split. Lines that begin with ``#``, have
    fewer than four fields or no number as position are no records. A record reaches the
    positions that its REF spans, and can match no other. ``positions`` (column pos) are
    counted and written once; every task reads them, so more than ``most_positions`` are
    an error: join those with the records of an unfiltered scan.

    Bytes that are no UTF-8 are replaced. A file without records gives no rows, an empty
    table of positions none at all.
    """
    if positions is None:
        return _loaded(spark, paths, splitBytes=str(split_bytes))
    named = positions.select("pos").where("pos IS NOT NULL").distinct()
    where = shared_path(spark, "positions")
    named.coalesce(1).write.parquet(where)
    if spark.read.schema("pos long").parquet(where).count() > most_positions:
        raise ValueError(f"more than {most_positions} positions: scan without them and join")
    return _loaded(spark, paths, positions=where, splitBytes=str(split_bytes))


def headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file and value: the column line of each file; nothing beyond the header is read."""
    return _loaded(spark, paths, kind="header").select("file", "value")
