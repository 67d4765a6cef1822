"""Token counts of whole texts with a sentencepiece model; ids never leave the task.

Arrow functions encode batches of about equal bytes and return lengths only. A long text
is split where no piece of the vocabulary reaches across, so its parts' counts add up.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import slices, text_bytes

#: What stands before a part that does not open its text: no piece holds a newline, so it shields the part from the model's opening space.
_SHIELD = "\n"


class PieceCounter:
    """Counts of the ids that a sentencepiece model of kind BPE gives whole texts.

    A merge only ever makes a piece of the vocabulary. So two neighbouring characters that
    stand side by side in no piece are never merged, and a text may be cut between them.
    That holds while characters are passed to the model as they are; with a model that
    normalises texts or is of another kind, texts are not cut.
    """

    def __init__(self, path: str, part_bytes: int = 1 << 16, batch_bytes: int = 1 << 18):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.part_bytes, self.batch_bytes = part_bytes, batch_bytes
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind, norm = proto.trainer_spec, proto.normalizer_spec
        plain = norm.name == "identity" and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        pieces = [p.piece for p in proto.pieces if p.type in (p.NORMAL, p.USER_DEFINED, p.UNUSED)]
        self.pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        self.cuts = plain and kind.model_type == kind.BPE and kind.byte_fallback and not any(_SHIELD in p for p in pieces)
        self.shield = len(self.model.encode(_SHIELD))

    def _safe(self, a: str, b: str) -> bool:
        return (a.replace(" ", "▁"), b.replace(" ", "▁")) not in self.pairs

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about ``part_bytes`` characters at most, as far as there are safe boundaries."""
        at = 0
        while self.cuts and len(text) - at > self.part_bytes:
            end = at + self.part_bytes
            while end > at + 1 and not self._safe(text[end - 1], text[end]):
                end -= 1
            if end == at + 1:  # none in this stretch: look further on
                end = at + self.part_bytes + 1
                while end < len(text) and not self._safe(text[end - 1], text[end]):
                    end += 1
            yield text[at:end]
            at = end
        if at < len(text) or not at:
            yield text[at:]

    def counts(self, texts: Iterator[str]) -> list[int]:
        """Number of ids of each text."""
        out: list[int] = []
        row, held, size = [], [], 0
        for k, text in enumerate(texts):
            out.append(0)
            for j, part in enumerate(self.parts(text) if len(text) > self.part_bytes else (text,)):
                row.append(k)
                held.append(_SHIELD + part if j else part)
                out[k] -= self.shield if j else 0
                size += len(part)
                if size >= self.batch_bytes:
                    self._count(row, held, out)
                    row, held, size = [], [], 0
        self._count(row, held, out)
        return out

    def _count(self, row: list[int], held: list[str], out: list[int]) -> None:
        for k, ids in zip(row, self.model.encode(held, num_threads=1), strict=True):
            out[k] += len(ids)


@functools.lru_cache(2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row.

    Tokens are those of the sentencepiece file ``model`` for the whole text, without begin
    and end; strings that look like special tokens are ordinary text. Null and empty texts
    have none. Null ids, repeated rows and empty tables pass through and further columns
    are not read. A text of any length is taken whole, in parts of 64 KB of characters; one
    without any safe boundary (one letter over and over) is encoded in one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in slices(batches, "text"):
            column = batch.column("text")
            _, offsets = text_bytes(column)
            tokens = counter.counts(x.as_py() or "" for x in column)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
