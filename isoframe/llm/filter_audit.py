"""Audit of document filters that are applied one after another, in every order.

Whether a document fails each of five filters does not depend on the order, so all that
orders can differ in is a count per part of each of the 32 combinations of failures.
Those counts, reshaped to one axis per filter, are contracted with einsum: along each
axis a step takes what passes, what fails, or both.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoframe.llm.common import slices, text_bytes

#: Fixed: the filters by letter, and the symbols that filter D looks for.
FILTERS = "ABCDE"
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*|")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True

AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_MEASURES = ("n", "good", "toxic")


def _word_counts(raw: memoryview, piece: int = 1 << 20) -> tuple[int, int]:
    """Words and distinct words of a text, compared byte for byte, some of a long text at a time."""
    if len(raw) <= piece:
        words = bytes(raw).split()  # at runs of ASCII white space
        return len(words), len(set(words))
    total, kinds, rest = 0, set(), b""
    for at in range(0, len(raw), piece):
        chunk = rest + bytes(raw[at : at + piece])
        words = chunk.split()
        rest = words.pop() if words and not chunk[-1:].isspace() else b""
        total += len(words)
        kinds.update(words)
    if rest:
        total += 1
        kinds.add(rest)
    return total, len(kinds)


def failures(docs: DataFrame, min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 3, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, fails (bits 1, 2, 4, 8 for filters A to D) and digest (SHA-256 of the text) of every row.

    A: fewer than ``min_words`` words. B: distinct words are less than
    ``distinct_percent`` per cent. C: upper-case ASCII letters are more than
    ``upper_percent`` per cent of the code points. D: a character of ``#$%&*|``. A null
    text is empty (it fails A only), a null part is the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            raw = memoryview(data.tobytes())
            texts = [raw[a:b] for a, b in itertools.pairwise(offsets.tolist())]
            words = np.array([_word_counts(t) for t in texts], np.int64).reshape(-1, 2)
            inside = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
            points = inside((data & 0xC0) != 0x80)
            bits = (words[:, 0] < min_words) * 1 + (100 * words[:, 1] < distinct_percent * words[:, 0]) * 2
            bits = bits + (100 * inside(_UPPER[data]) > upper_percent * points) * 4 + (inside(_MARKS[data]) > 0) * 8
            digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(bits.astype(np.int32)), digest], ["doc_id", "part", "fails", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, fails int, digest binary")


def combination_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (with bit 16 for filter E), n, good and toxic: rows of each combination of failures.

    A row fails E if a row with a smaller id has its text, whatever else happens to that
    row; equal and null ids are not smaller, and a null id has none smaller. ``good`` and
    ``toxic`` count rows whose id has a label of quality or toxic 1 (ids that are labelled
    more than once count if any label says so).

    Rows are counted by text and id, then by text with the count of the smallest id, each
    combined before it is shuffled, so copies of one text never meet in one task.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    marked = failed.join(known.hint("merge"), "doc_id", "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")})
    group = ["digest", "part", "fails", "good", "toxic"]
    by_id = marked.groupBy(*group, "doc_id").agg(F.count("*").alias("c"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c")))
    by_text = by_id.groupBy(*group).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("nameless"), first.alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    by_text = by_text.withColumn("new", F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.c")).otherwise(0))
    sides = F.array(F.struct(F.lit(0).alias("e"), F.col("new").alias("n")), F.struct(F.lit(16).alias("e"), (F.col("n") - F.col("new")).alias("n")))
    cells = by_text.select("part", "fails", "good", "toxic", F.explode(sides).alias("s")).where("s.n > 0")
    amount = F.col("s.n")
    return cells.groupBy("part", (F.col("fails") + F.col("s.e")).cast("int").alias("fails")).agg(
        F.sum(amount).alias("n"), F.sum(F.when(F.col("good"), amount).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), amount).otherwise(0)).alias("toxic")
    )


def contracted(counts: np.ndarray) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders.

    ``counts`` has an axis of measures (all, good, toxic) and one of length two for each
    filter: what passes it and what fails it.
    """
    take = {"pass": np.array([1, 0]), "fail": np.array([0, 1]), "all": np.array([1, 1])}

    def of(**along: str) -> np.ndarray:
        return np.einsum("mabcde,a,b,c,d,e->m", counts, *(take[along.get(f, "all")] for f in FILTERS))

    rows = []
    for order in itertools.permutations(FILTERS):
        for k, letter in enumerate(order):
            before = dict.fromkeys(order[:k], "pass")
            removed = of(**before, **{letter: "fail"})
            failing = of(**{letter: "fail"})[0]
            alone = of(**{f: "fail" if f == letter else "pass" for f in FILTERS})[0]
            kept = of(**before, **{letter: "pass"})[0]
            rows.append(("".join(order), k + 1, kept, removed[0], failing - removed[0], alone, removed[1], removed[2]))
    shapley = dict.fromkeys(FILTERS, 0)
    for order, step, _, removed, *_ in rows:
        shapley[order[step - 1]] += removed
    return [(*r, shapley[r[0][r[1] - 1]]) for r in rows]


def audited(cells: DataFrame) -> DataFrame:
    """Columns of AUDIT for every part, order and step, from the counts of ``combination_counts`` (at most 32 rows a part)."""

    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros((len(_MEASURES), 32), np.int64)
        for m, name in enumerate(_MEASURES):
            counts[m, table.column("fails").to_numpy()] = table.column(name).to_numpy()
        # Bit k of the combination is filter k; a reshape makes the last axis the lowest bit.
        tensor = counts.reshape(len(_MEASURES), *(2,) * 5).transpose(0, 5, 4, 3, 2, 1)
        rows = contracted(tensor)
        part = table.column("part")[0].as_py()
        columns = list(zip(*rows, strict=True))
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        names = [f.split(" ")[0] for f in AUDIT.split(", ")]
        return pa.table([pa.array([part] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return cells.groupBy("part").applyInArrow(run, AUDIT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step (columns of AUDIT).

    kept and removed count rows of the part after and at the step; redundant ones fail its
    filter but were removed before; unique_fails fail no other filter; good_lost and
    toxic_lost are removed rows of ids labelled so; shapley is what the filter removes,
    summed over all orders.

    An empty table has no parts and no rows. Null ids and texts, repeated rows, texts of
    any length and further columns are fine (see ``failures``, ``combination_counts``).
    """
    return audited(combination_counts(failures(docs), labels))
