"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import field, slices, text_bytes
from isoframe.llm.textstats import Slice


@dataclass
class Trees:
    """Complete binary trees of one depth, laid out in arrays [tree, node]."""

    base: float
    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, split, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > split[node])
            out += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-out))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Fit on logistic loss; splits are searched on per-feature histograms of gradients.

    Without rows the score is 0.5 everywhere; with one class it is that class's rate
    (shrunk by one row of either class).
    """
    n, inner = len(x), (1 << depth) - 1
    positive = (y.sum() + 1) / (n + 2)
    base = float(np.log(positive / (1 - positive)))
    feature, split, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 1 << depth))
    if n == 0 or y.min() == y.max():
        return Trees(base, feature[:0], split[:0], leaf[:0])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], axis=1)
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-12)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            at, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            local = node - at
            for f, q in enumerate(cuts):
                key = local * bins + binned[:, f]
                hist_g = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hist_h = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                all_g, all_h = hist_g[:, -1:], hist_h[:, -1:]
                gain = hist_g**2 / (hist_h + ridge) + (all_g - hist_g) ** 2 / (all_h - hist_h + ridge) - all_g**2 / (all_h + ridge)
                gain = gain[:, : len(q)]
                if gain.shape[1] == 0:
                    continue
                k = gain.argmax(1)
                value = gain[np.arange(width), k]
                better = value > best + 1e-9
                best[better] = value[better]
                feature[t, at : at + width][better] = f
                split[t, at : at + width][better] = q[k[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > split[t][node])
        local = node - inner
        leaf[t] = rate * np.bincount(local, g, 1 << depth) / (np.bincount(local, h, 1 << depth) + ridge)
        margin += leaf[t][local]
    return Trees(base, feature, split, leaf)


def statistics(docs: DataFrame, extra: str = "") -> DataFrame:
    """Document statistics of every row of (doc_id, text) as an array column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = Slice(*text_bytes(batch.column("text"))).features()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def in_hold_out(doc_id, folds: int = 3, fold: int = 1):
    """Whether crc32 of the id as text leaves the remainder ``fold``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000, folds: int = 3, fold: int = 1, **options) -> Trees:
    """Fit on labelled rows outside the held-out fold, at most ``max_rows`` of them.

    The rows taken are those of the smallest hash of their id, so the sample is the same
    on every run; its ids are broadcast (max_rows numbers) and only its statistics come
    to the driver. Ids labelled more than once count with their largest label; where ids
    repeat among the documents, at most ``max_rows`` rows are taken.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~in_hold_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    ids = {r.doc_id: r.y for r in known.collect()}
    if not ids:
        return boost(np.zeros((0, 1)), np.zeros(0), **options)
    sample = docs.sparkSession.createDataFrame([(k,) for k in ids], "doc_id long")
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left_semi")
    rows = statistics(chosen).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows).toPandas()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    x = np.array(rows["x"].tolist(), np.float64)[order] if len(rows) else np.zeros((0, 1))
    y = np.array([ids[i] for i in rows["doc_id"].to_numpy()[order]], np.float64)
    return boost(x, y, **options)


def scored_rows(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """(row, score): every row of ``docs`` as a struct of all its columns, and its text's score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    column = f"row.{text_col}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            p = held.value.scores(Slice(*text_bytes(field(batch, column))).features())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p)], ["row", "score"])

    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, f"row struct<{fields}>, score double")


def score(docs: DataFrame, model: Trees, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts are scored by their (zero) statistics, a text of any length by
    those of all of it (in about a hundred times its bytes of memory). Null ids, repeated rows
    and empty tables pass through; columns beside doc_id and text are never inputs.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            p = held.value.scores(Slice(*text_bytes(batch.column("text"))).features())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", in_hold_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
