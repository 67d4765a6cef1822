"""Base rules and a log-likelihood ratio of hashed n-grams over whole texts.

Words and word pairs are hashed to buckets whose number grows with the corpus. One
multinomial is counted over the trusted documents, one over the whole corpus; a
document's score is the mean log ratio of its n-grams' probabilities. The threshold is
derived from the scores of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import mix, slices, text_bytes
from isoframe.llm.textstats import Slice

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean"


def _ngrams(s: Slice, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each word and each pair of neighbouring words."""
    at, pairs = s.windows(2)
    shift = np.uint64(64 - bits)
    rows = np.concatenate([s.row, s.row[at]])
    return rows, np.concatenate([mix(s.words) >> shift, mix(pairs) >> shift]).astype(np.int64)


def bucket_bits(docs: DataFrame, text_col: str = "text", least: int = 12) -> int:
    """Bits of a bucket number: buckets grow with the square root of the corpus, so common n-grams are told apart at any size."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(least, 4 + -(-int(size // 6).bit_length() // 2))


def fit(docs: DataFrame, trusted: DataFrame, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> np.ndarray:
    """Log ratio per bucket, add-one smoothed: trusted documents against all documents.

    ``trusted`` holds the ids of the trusted documents; null and repeated ids there are
    ignored, and every row of a trusted id counts. Counts cover every document, null and
    empty texts have none, and an empty table or nobody trusted gives ratios of about 0.
    Each task gives the buckets it has seen, which Spark adds up; 2**bits sums (``bits``
    from ``bucket_bits``) reach the driver. The ids are broadcast while there are at most
    ``broadcast_rows`` (counted), else joined by a shuffle.
    """
    bits = bits or bucket_bits(docs, text_col)
    ids = trusted.select(F.col(trusted.columns[0]).alias("_id")).where("_id IS NOT NULL").distinct()
    hint = "broadcast" if ids.count() <= broadcast_rows else "merge"
    marked = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    marked = marked.join(ids.withColumn("_trusted", F.lit(True)).hint(hint), F.col("_doc") == F.col("_id"), "left").select("text", "_trusted")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in slices(batches, "text"):
            s = Slice(*text_bytes(batch.column("text")))
            rows, buckets = _ngrams(s, bits)
            np.add.at(raw, buckets, 1)
            good = batch.column("_trusted").is_valid().to_numpy(zero_copy_only=False)
            np.add.at(target, buckets[good[rows]], 1)
        seen = np.flatnonzero(raw)
        for k in range(0, len(seen), 1 << 16):
            at = seen[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    sums = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.ones(1 << bits), np.ones(1 << bits)
    at = sums.column("bucket").to_numpy()
    raw[at] += sums.column("raw").to_numpy()
    target[at] += sums.column("target").to_numpy()
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def scored(
    docs: DataFrame, ratio: np.ndarray, min_words: int = 50, max_repeat: int = 50, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Statistics, score and base verdict of every row (columns of SCHEMA).

    A row fails the base rules if it has fewer than ``min_words`` words or more than
    ``max_repeat`` per cent of its words lie in repeated 3-word windows. A text without
    words scores 0 and fails. Null texts count as empty; null ids, repeated rows and
    empty tables pass through; texts of any length are taken whole; further columns are
    not read.
    """
    bits = len(ratio).bit_length() - 1
    held = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = Slice(*text_bytes(batch.column("text")))
            rows, buckets = _ngrams(s, bits)
            grams = np.bincount(rows, minlength=s.n)
            mean = np.bincount(rows, weights=held.value[buckets], minlength=s.n) / np.maximum(grams, 1)
            repeat = s.repeated_words(3)
            failed = (s.n_words < min_words) | (100 * repeat > max_repeat * s.n_words)
            columns = [s.n_words, s.word_chars(), s.symbols(), s.duplicate_lines()[1], repeat]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(mean), pa.array(failed)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, SCHEMA)


def threshold(rows: DataFrame, labels: DataFrame, label_col: str = "quality", bins: int = 4096) -> float:
    """The score that parts trusted (label 1) from rejected (label 0) documents best.

    Scores of labelled documents that pass the base rules are counted in ``bins`` equal
    bins. The cut is where the share of trusted documents above and of rejected ones
    below sum to most, in the middle of the widest such gap. Without rejected documents
    it is the least trusted score, without trusted ones minus infinity. Ids labelled more
    than once count with their largest label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("_y"))
    found = rows.where("NOT base_failed").select("doc_id", "score").join(known.hint("merge"), "doc_id").select("score", "_y")
    low, high = found.agg(F.min("score"), F.max("score")).first()
    if low is None or high <= low:
        return float("-inf") if low is None else float(low)
    place = F.least(F.lit(bins - 1), F.floor((F.col("score") - low) / (high - low) * bins))
    counts = np.zeros((2, bins))
    for r in found.groupBy(place.cast("int").alias("bin"), "_y").agg(F.count("*").alias("n")).collect():
        counts[int(r._y > 0), r.bin] += r.n
    if not counts[0].any() or not counts[1].any():
        return float(low) if counts[1].any() else float("-inf")
    # Cut k lies below bin k: rejected ones of bins before it are caught, trusted ones from it on are kept.
    caught = np.concatenate([[0], np.cumsum(counts[0])]) / counts[0].sum()
    lost = np.concatenate([[0], np.cumsum(counts[1])]) / counts[1].sum()
    gain = np.round(caught - lost, 12)
    best = np.flatnonzero(gain == gain.max())
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(runs, key=len)
    return float(low + (high - low) * (widest[0] + widest[-1]) / 2 / bins)


def judged(rows: DataFrame, cut: float) -> DataFrame:
    """Add kept to scored rows: they pass the base rules and score ``cut`` or more."""
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(cut)))
