"""WARC archives written and read through an index of byte ranges.

Writing gives one index row per record: file, offset, length, URL and digest. Readers
select index rows, sort them by place, join near ranges into few larger reads and cut
the records out of those. Records are gzip members, so each can be read by itself.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import slices

INDEX = "page_id long, file string, offset long, length long, url string, digest string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_ID = "urn:isoframe:page:"


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, revisit and refers_to (the id of the record that is stored whole).

    Of rows with equal payloads of at least ``min_bytes`` bytes exactly one is stored: that
    with the largest id, of several such that with the largest url, of equal rows any. A
    null id comes after all others, so rows without ids refer to one that has one;
    if none has, one is stored and the others refer to it without naming an id.

    Equal rows are told apart by their place in the input, which must be the same when it
    is read again, as that of stored tables is. The stored row of a payload is aggregated
    before the join, and adaptive execution splits the rows of a frequent payload.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("_place")
    ).withColumn("_sha", F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary"))))
    stored = rows.where("_sha IS NOT NULL").groupBy("_sha").agg(F.max(F.struct("page_id", "url", "_place")).alias("_stored"))
    revisit = F.coalesce(F.col("_place") != F.col("_stored._place"), F.lit(False))
    return rows.join(stored.hint("merge"), "_sha", "left").select(
        "page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("_stored.page_id")).alias("refers_to")
    )


def _record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, date: str, place: str) -> tuple[bytes, str]:
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = f"{_ID}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{_ID}{refers_to}>")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 30, level: int = 4) -> DataFrame:
    """Write one record per row of (page_id, url, html, revisit, refers_to); returns the index.

    A null url has no target line, an empty html an empty payload; a row without an id has
    a record id made from its place, rows with one id share theirs. A record is held in
    memory whole, so the longest html bounds that. An empty table writes no file.

    The returned table writes when it is evaluated: store it before reading. Every task
    attempt writes files of its own, so a lost or repeated task leaves at most files
    that no index row names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in slices(batches, "html"):
                index = []
                for row in batch.to_pylist():
                    if out is None or at >= file_bytes:
                        if out:
                            out.close()
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                        info = b"software: isoframe\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        at = out.write(gzip.compress(head.encode() + info + b"\r\n\r\n", level, mtime=0))
                    raw, digest = _record(row["page_id"], row["url"], row["html"].encode(), row["revisit"], row["refers_to"], date, f"{name}:{at}")
                    member = gzip.compress(raw, level, mtime=0)
                    out.write(member)
                    index.append((row["page_id"], name, at, len(member), row["url"], digest))
                    at += len(member)
                columns = list(zip(*index, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "file", "offset", "length", "url", "digest"])
        finally:
            if out:
                out.close()

    return rows.select("page_id", "url", "html", "revisit", "refers_to").mapInArrow(write, INDEX)


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(name: str | None) -> int | None:
    return int(name[len(_ID) + 1 : -1]) if name and name.startswith("<" + _ID) else None


def read_archives(index: DataFrame, folder: str, gap: int = 1 << 16, read_bytes: int = 8 << 20, span: int = 32 << 20, keep_payload: bool = True) -> DataFrame:
    """Records (columns of RECORDS) named by index rows, in any selection.

    Tasks take spans of ``span`` bytes of a file in order of offset, about one span a
    task; ranges less than ``gap`` apart are read at once, up to ``read_bytes`` or one
    record. Index rows that repeat give their record again, an empty index gives none. Digest and size are those of
    the payload that was read; a revisit has no payload, so it carries those of its
    header lines. A stored digest that does not match is an error.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        held: tuple[str, object] = ("", None)
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            at = 0
            while at < len(places):
                file, first, size = places[at]
                end, upto = at + 1, first + size
                while end < len(places) and places[end][0] == file and places[end][1] - upto <= gap and places[end][1] + places[end][2] - first <= read_bytes:
                    upto = max(upto, places[end][1] + places[end][2])
                    end += 1
                if held[0] != file:
                    held = (file, store.open_input_file(f"{root}/{file}"))
                data = held[1].read_at(upto - first, first)
                rows = []
                for _, offset, length in places[at:end]:
                    fields, block = _parsed(gzip.decompress(data[offset - first : offset - first + length]))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest32(payload) != said:
                        raise ValueError(f"digest of {file} at {offset} does not match")
                    n = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    rows.append((
                        _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, _page(fields.get("WARC-Refers-To")), said,
                        len(payload) if kind == "response" else n, payload if keep_payload and kind == "response" else None,
                    ))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                at = end

    ranges = index.select("file", "offset", "length").withColumn("_span", F.expr(f"offset div {span}"))
    spans = ranges.select(F.count_distinct("file", "_span")).first()[0]
    return ranges.repartition(max(1, min(spans, 100_000)), "file", "_span").sortWithinPartitions("file", "offset").drop("_span").mapInArrow(fetch, RECORDS)
