"""Exact k-means over integer vectors; the nearest centroid is found by Orchard's search.

Every centroid has a list of the others by distance. A vector walks down the list of the
best centroid so far, jumps to the list of a closer one whenever it finds it, and stops
where the list is strictly beyond twice its distance: what follows cannot be as near.
All numbers are integers, so sums and means are exact on any number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import written

#: Components below this size have squared distances that fit 64 bits (up to 256 components of twice the size).
_LARGEST = 1 << 26


class Centroids:
    """Centroids, their distances and each one's list of the others, nearest first."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.apart = np.array([((points - p) ** 2).sum(axis=1) for p in points])
        self.lists = np.array([np.lexsort((np.arange(len(points)), d)) for d in self.apart])

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of each vector (ties: the smaller number), the squared distance, and how many distances were taken.

        All vectors of the batch walk at once, each on its own list.
        """
        n, k = len(vectors), len(self.points)
        best = np.zeros(n, np.int64)
        distance = ((vectors - self.points[0]) ** 2).sum(axis=1)
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        at = np.ones(n, np.int64)  # the list's first entry is the centroid itself
        walking = np.arange(n if k > 1 else 0)
        taken = n
        while len(walking):
            other = self.lists[best[walking], at[walking]]
            # Stop strictly beyond twice the distance: apart > 4 * distance, without leaving 64 bits.
            inside = (self.apart[best[walking], other] - 1) // 4 < distance[walking]
            walking, other = walking[inside], other[inside]
            new = ~visited[walking, other]
            row, centroid = walking[new], other[new]
            visited[row, centroid] = True
            found = ((vectors[row] - self.points[centroid]) ** 2).sum(axis=1)
            taken += len(row)
            closer = (found < distance[row]) | (found == distance[row]) & (centroid < best[row])
            at[walking] += 1
            jump = row[closer]
            best[jump], distance[jump], at[jump] = centroid[closer], found[closer], 0
            walking = walking[at[walking] < k]
        return best, distance, taken


def kept_vectors(table: DataFrame, size: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (little-endian 32-bit integers floor(``scale`` * x)) of rows with exactly ``size`` finite components.

    A component that is scaled to 2**26 or more is an error: its distances might not fit 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            right = np.array(pc.fill_null(pc.list_value_length(column), -1)) == size
            batch = batch.filter(pa.array(right))
            values = batch.column("v").flatten()
            x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # null components are NaN
            finite = np.isfinite(x).all(axis=1)
            whole = np.floor(scale * x[finite])
            if (np.abs(whole) >= _LARGEST).any():
                raise ValueError(f"components must be below {_LARGEST // scale} in size")
            raw = pa.array([r.tobytes() for r in whole.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(finite)), raw], ["vec_id", "v"])

    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v binary")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, size).astype(np.int64)


def first_centroids(vectors: DataFrame, clusters: int, seed: str, size: int = 64) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed`` and id, in that order; equal ids by their components, null ids last."""
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return np.array([np.frombuffer(bytes(r.v), "<i4") for r in rows], np.int64).reshape(-1, size)


def _moved(vectors: DataFrame, points: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the exact means of their vectors; empty ones stay.

    Tasks add their vectors up, so one row for each task and centroid is shuffled.
    """
    size = points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, sums, count = Centroids(points), np.zeros_like(points), np.zeros(len(points), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), size)
            best = centroids.nearest(v)[0]
            count += np.bincount(best, minlength=len(points))
            order = np.argsort(best, kind="stable")
            held = np.flatnonzero(np.bincount(best, minlength=len(points)))
            if len(held):
                sums[held] += np.add.reduceat(v[order], np.searchsorted(best[order], held), axis=0)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    part = vectors.select("v").mapInArrow(run, "cluster long, n long, sums array<long>")
    # Sums of a task fit 64 bits up to 2**37 vectors; those of all tasks are added as decimals.
    terms = part.select("cluster", F.posexplode(F.concat("sums", F.array("n"))).alias("place", "term"))
    totals = np.zeros((len(points), size + 1), object)
    for r in terms.groupBy("cluster", "place").agg(F.sum(F.col("term").cast("decimal(20,0)")).alias("total")).collect():
        totals[r.cluster, r.place] = int(r.total)
    out = points.copy()
    held = np.flatnonzero(totals[:, size])
    out[held] = totals[held, :size] // totals[held, size:]
    return out


def cluster(
    table: DataFrame, clusters: int = 8, rounds: int = 10, seed: str = "3:", size: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors of exactly ``size`` components, all finite (see ``kept_vectors``);
    others give no row. The first centroids are those of ``first_centroids``; ``rounds``
    times every vector goes to the nearest one (ties: the smaller number) and every
    centroid to the floor of its vectors' mean, or stays if it has none; then vectors are
    assigned once more. The digest is over the centroid's components, joined by commas.

    Fewer vectors than ``clusters`` give as many centroids, none give no rows. Repeated
    rows count as often as they are there; null ids are kept and start no centroid while
    enough others do. Further columns are not read. The driver holds the centroids only.
    """
    spark = table.sparkSession
    vectors = written(kept_vectors(table, size, scale, id_col, vector_col), "vectors")
    points = first_centroids(vectors, clusters, seed, size)
    for _ in range(rounds if len(points) else 0):
        moved = _moved(vectors, points)
        if (moved == points).all():  # later rounds would find the same
            break
        points = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(points)
        for batch in batches:
            best, distance, _ = centroids.nearest(_matrix(batch.column("v"), size))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    rows = written(vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    found = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    digest = lambda p: hashlib.sha256(",".join(map(str, p.tolist())).encode()).hexdigest()
    facts = [(k, d, sum(found.values()), digest(points[k])) for k, d in found.items()]
    # One row for each centroid, so a broadcast is as small as the parameter says.
    sums = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
