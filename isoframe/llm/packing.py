"""Token windows of fixed length, packed by best-fit decreasing.

Documents are tokenized, closed by one end id and cut into full windows and one
remainder. Remainders, longest first, go to the open window that they fill best; a
segment tree over remaining capacities finds it.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import apart_hash, same_bytes, slices, text_bytes, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
#: Fixed: white space outside ASCII, which a byte-wise cut at spaces must not touch.
_WIDE_SPACE = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes between which a single space parts two pre-tokens: all but control characters and white space.
_SOLID = np.ones(256, bool)
_SOLID[:0x21] = False
_SOLID[0x7F] = False


class ChunkEncoder:
    """Byte-level BPE ids of many texts; each distinct chunk of text is encoded once.

    A chunk runs from a single space between two other characters up to the next one.
    The pre-tokenizer never joins characters across such a space, so ids of a text are
    the ids of its chunks in order. Texts with white space outside ASCII are one chunk.
    Chunks are looked up by hash and then compared byte for byte; one whose bytes differ
    from those kept under its hash is encoded by itself.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.widths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        for token, i in self.tokenizer.get_vocab().items():
            self.widths[i] = len(token.encode()) if i in special else len(token)
        self._clear()

    def _clear(self) -> None:
        """The cache: sorted keys, the slot of each, and by slot ids and bytes, which only grow."""
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.raw_at, self.raw = np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks laid end to end, and how many each has."""
        joined, at = [], 0
        sizes = np.array([len(c) for c in chunks])
        ends = np.cumsum(sizes)
        while at < len(chunks):  # some KB at a time: long strings are slow to encode
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 8192)))
            joined.append(b"".join(chunks[at:end]).decode("utf-8"))
            at = end
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, np.int32)
        stops = np.searchsorted(np.cumsum(self.widths[ids]), ends)
        return ids, np.diff(stops + 1, prepend=0)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows laid end to end, and row offsets."""
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data), bool)
        cut[1:-1] = (data[1:-1] == 0x20) & _SOLID[data[:-2]] & _SOLID[data[2:]]
        lead, then = data[:-1], data[1:]
        wide = (lead == 0xC2) & ((then == 0x85) | (then == 0xA0)) | (lead == 0xE1) & (then == 0x9A)
        wide |= (lead == 0xE2) & ((then == 0x80) | (then == 0x81)) | (lead == 0xE3) & (then == 0x80)
        for k in np.unique(np.searchsorted(offsets, np.flatnonzero(wide), "right") - 1).tolist():
            if _WIDE_SPACE.search(column[k].as_py()):
                cut[offsets[k] : offsets[k + 1]] = False
        edges = offsets[offsets < len(data)]
        cut[edges] = True
        # A space at a row's edge is no inner one, and its neighbour belongs to another row.
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        keys = apart_hash(data, starts, ends)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self._clear()
        place = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != distinct[inside]
        if new.any():
            raw = data.tobytes()
            # Chunks that open a row stand apart: only those that start with a space may follow another.
            chosen = first[new]
            spaced = (data[starts[chosen]] == 0x20) & ~np.isin(starts[chosen], edges)
            order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
            of = chosen[order]
            chunks = [raw[a:b] for a, b in zip(starts[of].tolist(), ends[of].tolist(), strict=True)]
            many = int(spaced.sum())
            ids, counts = self._encode(chunks[:many])
            alone = self._each(chunks[many:])
            self._add(distinct[new], order, np.concatenate([ids, *alone]), np.concatenate([counts, [len(x) for x in alone]]).astype(np.int64), chunks)
        place = self.slots[np.searchsorted(self.keys, distinct)][inverse]
        other = ~same_bytes(data, starts, ends, self.raw, self.raw_at[place], self.raw_at[place + 1])
        counts = self.at[place + 1] - self.at[place]
        source, base = self.ids, self.at[place]
        if other.any():  # different bytes under one hash
            apart = self._each([data[a:b].tobytes() for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
            counts[other] = [len(x) for x in apart]
            base[other] = len(source) + np.cumsum(counts[other]) - counts[other]
            source = np.concatenate([source, *apart])
        total = np.concatenate([[0], np.cumsum(counts)])
        take = np.arange(total[-1]) + np.repeat(base - total[:-1], counts)
        return source[take], total[np.searchsorted(starts, offsets)]

    def _each(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of every chunk, encoded by itself."""
        found = self.tokenizer.encode_batch_fast([c.decode("utf-8") for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]

    def _add(self, keys: np.ndarray, order: np.ndarray, ids: np.ndarray, counts: np.ndarray, chunks: list[bytes]) -> None:
        """Keep new chunks; ``keys`` are sorted, and chunk j is that of key ``order[j]``."""
        slots = np.empty(len(order), np.int64)
        slots[order] = len(self.keys) + np.arange(len(order))
        where = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, where, keys), np.insert(self.slots, where, slots)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids])
        self.raw_at = np.concatenate([self.raw_at, self.raw_at[-1] + np.cumsum([len(c) for c in chunks])])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(chunks), np.uint8)])


@functools.lru_cache(2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pieces (columns of PIECES) of every row: full windows, then the remainder.

    Null and empty texts are one piece, the end id. Special-token strings in a text are
    read as the tokenizer file says. ``ids_crc32`` is over the ids as little-endian
    unsigned 32-bit numbers; ``ids`` is null unless ``keep_ids``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in slices(batches, "text"):
            ids, at = encoder.encode(batch.column("text"))
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            sizes = np.diff(at)
            pieces = -(-sizes // window)
            row = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(sizes[row] - start, window)
            first = at[row] + start
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            kept = pa.ListArray.from_arrays(pa.array(np.append(first, at[-1]), pa.int32()), pa.array(ids.view("<i4"))) if keep_ids else pa.nulls(len(row), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[row]), kept],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; ``lengths`` must not rise.

    Leaf c of the tree holds the open windows with c ids left; an inner node says
    whether any leaf below it holds one. The tightest window for a piece is in the
    leftmost filled leaf from its length on.
    """
    width = 1 << window.bit_length()
    filled = bytearray(2 * width)
    open_at: list[list[int]] = [[] for _ in range(width)]
    used: list[int] = []
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, need in enumerate(lengths.tolist()):
        node = need + width
        if not filled[node]:
            while node > 1 and (node & 1 or not filled[node + 1]):
                node >>= 1
            node = node + 1 if node > 1 else 0
        if node:
            while node < width:
                node = 2 * node if filled[2 * node] else 2 * node + 1
            left = node - width
            s = open_at[left].pop()
            if not open_at[left]:
                filled[node] = 0
                node >>= 1
                while node and not filled[2 * node] and not filled[2 * node + 1]:
                    filled[node] = 0
                    node >>= 1
        else:
            s, left = len(used), window
            used.append(0)
        sequence[k], offset[k] = s, used[s]
        used[s] += need
        left -= need
        if left:
            open_at[left].append(s)
            node = left + width
            while node and not filled[node]:
                filled[node] = 1
                node >>= 1
    return sequence, offset


def pack(pieces: DataFrame, window: int = 1024, block_rows: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to each piece.

    Pieces are dealt by hash to blocks of about ``block_rows`` and each block is packed
    by itself; with so many remainders a block leaves hardly any padding. The blocks
    depend on the rows alone, so the result is the same on every run. Pieces that agree
    in id, start and checksum more than ``block_rows`` times are spread over all blocks.
    """
    blocks = max(1, -(-pieces.count() // block_rows))

    def place(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        order = np.lexsort([table.column("ids_crc32").to_numpy(), table.column("start").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy(), -length])
        sequence, offset = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        sequence[order], offset[order] = best_fit(length[order], window)
        block = table.column("_block").to_numpy().astype(np.int64)
        at = table.schema.get_field_index("_block")
        return table.remove_column(at).append_column("sequence_id", pa.array((block << 32) + sequence)).append_column("offset", pa.array(offset))

    own = F.xxhash64("doc_id", "start", "ids_crc32")
    dealt = pieces.withColumn("_own", own)
    repeated = pieces.groupBy(own.alias("_own")).agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows).select("_own")
    if blocks > 1 and not repeated.isEmpty():  # fewer than one in block_rows of all pieces
        spread = dealt.join(repeated.withColumn("_spread", F.lit(True)).hint("merge"), "_own", "left")
        salt = F.when(F.col("_spread"), F.monotonically_increasing_id()).otherwise(0)
        dealt = spread.withColumn("_own", F.xxhash64("_own", salt)).drop("_spread")
    dealt = dealt.withColumn("_block", F.pmod("_own", F.lit(blocks)).cast("int")).drop("_own").select(*pieces.columns, "_block")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("_block").applyInArrow(place, schema)


def packed(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, keep_ids: bool = True, block_rows: int = 20_000) -> DataFrame:
    """Tokenize, cut and pack all rows; see ``token_pieces`` and ``pack``.

    Pieces are written once, so texts are tokenized once. A text of any length is encoded
    whole, chunk by chunk. Null ids, repeated rows and
    empty tables are packed as they are; columns beside doc_id and text are not read.
    """
    pieces = token_pieces(docs, tokenizer, window, end_id, keep_ids)
    return pack(written(pieces if keep_ids else pieces.drop("ids"), "pieces"), window, block_rows)
