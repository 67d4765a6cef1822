"""Similarity self-join of documents on word shingles (Jaccard), with components.

Equal sets are one class. Classes are joined by a size-aware heavy-light join: shingles
are ordered by rarity, and two sets that link share at least one shingle of their
prefixes and two of their longer prefixes. Light (small) sets are listed under each
pair of shingles of the longer prefix, heavy sets under each shingle of the prefix.
The boundary is where enumerating pairs costs more than scanning lists of the length
that is measured on a sample of the shingles.

Links are only sought while they can still join two components: first of each list's
members with their neighbours and with the one that has most to share, then between
members of different components. Prefix shingles that no other prefix holds bound what
a set can share, which rules out most of the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.llm.common import COUNTS, LOWER, WHITE, count_rows, mix, release, shingle_hashes, slices, summed_counts, text_bytes, word_hashes, written
from isoframe.llm.components import connected

WIDTH = 5
_INDEX = "key long, id long, n int, pos int, stop long"


def sets_of(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, in order of row.

    A text of fewer words than ``width`` has its whole sequence as one shingle, a text
    without words has none.
    """
    data, offsets = text_bytes(column)
    words, firsts = word_hashes(LOWER[data], offsets, WHITE)
    n = np.diff(firsts)
    row = np.repeat(np.arange(len(n)), n)
    hashes = shingle_hashes(words, width)
    at = np.flatnonzero(row[: len(hashes)] == row[width - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    rows, found = [row[at]], [hashes[at]]
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        value = np.full(len(short), k, np.uint64)
        for j in range(k):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[firsts[short] + j])
        rows.append(short)
        found.append(value)
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[first], found[first]


def _digests(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each row's set, and one value that equal sets share."""
    size = np.bincount(rows, minlength=n_rows)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5)))])
    at = np.concatenate([[0], np.cumsum(size)])
    return size, mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64)).view(np.int64)


def document_sets(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", sample_bits: int = 10) -> DataFrame:
    """doc_id, text_key (hash of the text), n (set size), digest (equal for equal sets) and sampled of every row.

    ``sampled`` holds those shingles whose hash ends in ``sample_bits`` zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, hashes = sets_of(batch.column("text"), width)
            size, digest = _digests(rows, hashes, batch.num_rows)
            few = (hashes & np.uint64((1 << sample_bits) - 1)) == 0
            at = np.concatenate([[0], np.cumsum(np.bincount(rows[few], minlength=batch.num_rows))])
            sampled = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes[few].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(size.astype(np.int32)), pa.array(digest), sampled], ["doc_id", "text_key", "n", "digest", "sampled"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n int, digest long, sampled array<long>")


def list_length(sets: DataFrame, percent: int) -> float:
    """Mean length of the lists that a prefix entry stands in, over the sampled shingles.

    Lists hold distinct sets. The rarest (100 - percent) per cent of all entries are
    taken, as prefixes hold the rarest shingles of each set.
    """
    lists = sets.select("digest", F.explode("sampled").alias("key")).distinct().groupBy("key").agg(F.count("*").alias("length"))
    found = sorted((r.length, r.n) for r in lists.groupBy("length").agg(F.count("*").alias("n")).collect())
    left = total = sum(length * n for length, n in found) * (100 - percent) / 100
    weight = 0.0
    for length, n in found:
        taken = min(left, length * n)
        weight += taken * length
        left -= taken
    return weight / total if total else 1.0


def boundary(length: float, percent: int, longest: int = 12) -> int:
    """Largest set size at which enumerating the prefix's pairs is no dearer than scanning its lists of mean ``length``.

    A prefix of p entries has p * (p + 1) / 2 pairs; it scans p * length entries. Prefixes
    of more than ``longest`` entries are never enumerated, which bounds what a set takes.
    At 50 per cent or less sets may link by one shingle, so none are light.
    """
    most = min(longest, max(1, int(2 * length - 1)))
    sizes = np.arange(1, 100 * longest)
    return int(sizes[sizes - _needed(sizes, percent) + 1 <= most].max()) if percent > 50 else 0


def order_bits(docs: DataFrame, text_col: str) -> int:
    """Bits of the buckets by which shingles are ordered: they grow with the corpus, up to 16 million counters.

    Any order gives the same links; a fuller table only makes lists longer.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return min(24, max(20, 4 + -(-int(size // 6).bit_length() // 2)))


def shingle_counts(docs: DataFrame, width: int, bits: int, text_col: str) -> np.ndarray:
    """How many documents hold a shingle of each of 2**bits hash buckets: a rarity order of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in slices(batches, "text"):
            hashes = sets_of(batch.column("text"), width)[1]
            total += np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        yield count_rows(total)

    counts = summed_counts(docs.select(F.col(text_col).alias("text")).mapInArrow(run, COUNTS))
    return counts if len(counts) else np.zeros(1 << bits, np.int64)


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def prefix_index(docs: DataFrame, counts: np.ndarray, light: int, percent: int, width: int, text_col: str) -> DataFrame:
    """List entries (columns of _INDEX) of every set; id is the set's digest.

    ``stop`` is the count at which the set's prefix ends in the order of rarity.

    Sets of up to ``light`` shingles are listed under pairs; those large enough to link
    with a larger set also under single shingles. Keys of pairs and of single shingles
    are told apart by their last bit.
    """
    bits = len(counts).bit_length() - 1
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task are listed once
        for batch in slices(batches, "text"):
            rows, hashes = sets_of(batch.column("text"), width)
            size, digest = _digests(rows, hashes, batch.num_rows)
            fresh = np.zeros(batch.num_rows, bool)
            if len(seen) > 1_000_000:  # forgetting only lists some copies again
                seen.clear()
            for k, d in enumerate(digest.tolist()):
                if d not in seen:
                    seen.add(d)
                    fresh[k] = True
            keep = fresh[rows]
            rows, hashes = rows[keep], hashes[keep]
            count = held.value[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.lexsort((hashes, count, rows))
            rows, hashes, count = rows[order], hashes[order], count[order]
            at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))])
            pos = np.arange(len(rows)) - at[rows]
            n = size[rows]
            prefix = n - _needed(n, percent) + 1
            last = at[:-1] + np.minimum(size - _needed(size, percent), np.maximum(size - 1, 0))
            stop = count[np.minimum(last, max(len(count) - 1, 0))] if len(count) else np.zeros(len(size))
            single = (pos < prefix) & (n >= _needed(np.int64(light + 1), percent))
            keys, owner, place = [hashes[single] & ~np.uint64(1)], [rows[single]], [pos[single]]
            longest = int(light - _needed(np.int64(light), percent) + 2) if light else 0
            for i in range(longest):
                for gap in range(1, longest - i):
                    first = np.flatnonzero((pos == i) & (n <= light) & (i + gap < np.minimum(prefix + 1, n)))
                    keys.append(mix(hashes[first] + mix(hashes[first + gap])) | np.uint64(1))
                    owner.append(rows[first])
                    place.append(np.full(len(first), i))
            owner = np.concatenate(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(digest[owner]), pa.array(size[owner].astype(np.int32)), pa.array(np.concatenate(place).astype(np.int32)), pa.array(stop[owner].astype(np.int64))],
                ["key", "id", "n", "pos", "stop"],
            )

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, _INDEX)


def _may_link(x: str, y: str, percent: int, light: int) -> Column:
    """Whether sizes, the most that they can share, and the place of the shared shingle allow a link.

    ``x`` and ``y`` name structs of n, id, pos, stop and most, with x's set not larger; one
    of two sets that share a single shingle must be heavy. A set whose prefix stops first
    shares no more than its ``most`` with the other, as all its prefix shingles that the
    other holds are in the other's prefix too. That holds where both sets are listed under
    single shingles; a smaller x is not, so its pairs pass on size and place alone.
    """
    listed = int(_needed(np.int64(light + 1), percent))
    need = f"ceil({percent} * ({x}.n + {y}.n) / {100 + percent})"
    bound = f"CASE WHEN {x}.stop < {y}.stop THEN {x}.most WHEN {y}.stop < {x}.stop THEN {y}.most ELSE greatest({x}.most, {y}.most) END"
    whole = f"{100 + percent} * ({bound}) >= {percent} * ({x}.n + {y}.n)"
    place = f"{x}.pos <= {x}.n - {need} AND {y}.pos <= {y}.n - {need}"
    return F.expr(f"{x}.id <> {y}.id AND 100 * {x}.n >= {percent} * {y}.n AND ({x}.n < {listed} OR {whole}) AND {place} AND ((key & 1) = 1 OR {y}.n > {light})")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Those pairs (a, b) whose texts' sets link, by exact intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "text_a", 2 << 20):
                sides, sizes = [], []
                for c in ("text_a", "text_b"):
                    rows, hashes = sets_of(batch.column(c), width)
                    sizes.append(np.bincount(rows, minlength=batch.num_rows))
                    sides.append((mix(hashes + mix(rows.astype(np.uint64) + np.uint64(1))), rows))
                _, at, _ = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
                both = np.bincount(sides[0][1][at], minlength=batch.num_rows)
                linked = pa.array(100 * both >= percent * (sizes[0] + sizes[1] - both))
                yield batch.select(["a", "b"]).filter(linked)

    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(
    docs: DataFrame, percent: int = 80, width: int = WIDTH, sketch_bits: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    light: int | None = None,
) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and root of every row.

    Sets of up to ``light`` shingles are listed under pairs (see ``boundary``). Shingles
    are ordered by counts of 2**``sketch_bits`` buckets (see ``order_bits``).
    ``text_key`` is the hash of the row's text, ``root`` a value that the rows of one
    component share (null for a row without words).

    Two rows link when 100 * intersection >= percent * union of their sets; the
    component is named by its smallest id. Rows without words have no shingles and stay
    alone. Null ids take part in links but never name a component (a component of null
    ids only has a null name). Repeated rows, empty tables and other columns are fine.

    A text of any length is taken whole (in about a hundred times its bytes of memory).

    Sets are compared by 64-bit hashes of shingles, sets by 64-bit digests.
    """
    spark = docs.sparkSession
    sets = written(document_sets(docs, width, id_col, text_col), "sets")
    classes = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("_least"), F.min("text_key").alias("text_key"), F.max("n").alias("n"))
    classes = written(classes, "classes")
    light = boundary(list_length(sets, percent), percent) if light is None else light
    counts = shingle_counts(docs, width, sketch_bits or order_bits(docs, text_col), text_col)
    index = prefix_index(docs, counts, light, percent, width, text_col)

    # Lists of more than one set; entries of lists of one are counted by what is missing.
    order = Window.partitionBy("key").orderBy("n", "id")
    nearby = index.withColumn("_next", F.lead("id").over(order)).withColumn("_before", F.lag("id").over(order))
    lists = written(nearby.where("_next <> id OR _before <> id").select(*index.columns), "lists")
    release(spark)

    # A shingle that stands in no other prefix bounds what a set can share with those that have longer prefixes.
    shared = lists.where("(key & 1) = 0").groupBy("id").agg(F.count_distinct("key").alias("_m"))
    prefix = F.expr(f"n - ceil({percent} * n / 100) + 1")
    most = F.when(F.col("n") >= int(_needed(np.int64(light + 1), percent)), F.col("n") - prefix + F.coalesce("_m", F.lit(0))).otherwise(F.col("n"))
    able = lists.distinct().join(shared.hint("merge"), "id", "left").withColumn("most", F.least("n", most).cast("int"))
    able = written(able.select("key", F.struct("n", "id", "pos", "stop", "most").alias("s")), "able")
    release(spark)

    # First links: to the next of each list in order of size, and to the set of the list that has most to share.
    of_key = Window.partitionBy("key")
    tops = able.withColumn("_next", F.lead("s").over(of_key.orderBy("s"))).withColumn(
        "_hub", F.max(F.struct((F.col("s.most") / F.col("s.n")).alias("share"), F.col("s"))).over(of_key)
    )

    def ordered(x: str, y: str) -> list[Column]:
        return [F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b")]

    tried = tops.select("key", "s", F.explode(F.array("_next", "_hub.s")).alias("o"))
    tried = tried.select("key", F.least("s", "o").alias("x"), F.greatest("s", "o").alias("y"))
    near = written(tried.where(_may_link("x", "y", percent, light)).select(*ordered("x", "y")).distinct(), "pairs")
    release(spark)

    def texts_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = ids.join(classes.select(F.col("digest").alias("id"), "text_key").hint("merge"), "id")
        found = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).join(wanted.hint("merge"), "text_key")
        return written(found.groupBy("id").agg(F.first("text").alias("text")), "texts")

    links = written(verified(near, texts_of(near), percent, width), "links")
    roots = written(connected(links), "roots")
    release(spark)

    # Then all pairs of a list that are still in different components and may link.
    placed = able.join(roots.select(F.col("node").alias("_id"), "root").hint("merge"), F.col("s.id") == F.col("_id"), "left")
    placed = placed.select("key", "s", F.coalesce("root", "s.id").alias("root"))
    mixed = placed.withColumn("_low", F.min("root").over(of_key)).withColumn("_high", F.max("root").over(of_key)).where("_low <> _high")
    mixed = written(mixed.drop("_low", "_high"), "mixed")
    x, y = mixed.select("key", F.col("s").alias("x"), F.col("root").alias("root_x")), mixed.select("key", F.col("s").alias("y"), F.col("root").alias("root_y"))
    cross = x.join(y.hint("merge"), "key").where("root_x <> root_y AND x < y").where(_may_link("x", "y", percent, light))
    cross = written(cross.select(*ordered("x", "y")).distinct().join(near.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    more = verified(cross, texts_of(cross), percent, width)
    roots = written(connected(written(links.unionByName(more), "links")), "roots")
    release(spark)

    # Tables that are joined are written first: a join of plain tables is one that Spark splits.
    named = classes.join(roots.select(F.col("node").alias("digest"), "root").hint("merge"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    named = written(named.select("digest", "root", "_least"), "named")
    least = written(named.groupBy("root").agg(F.min("_least").alias("component_id")), "least")
    by_set = named.select("digest", "root").join(least.hint("merge"), "root").select("digest", "component_id", "root")
    return sets.join(by_set.hint("merge"), "digest", "left").select(
        "doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root"
    )
