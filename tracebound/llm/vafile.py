"""Nearest centroids and k-means over a vector-approximation file (operator 13).

Every vector is kept twice in one Parquet folder: whole, and as a cell of ``BITS`` bits in each
dimension. Lookup tables give the middle and half width of a cell, and two matrix products turn
them into an interval for the distance to every centroid (less the distance to the mean of the
centroids, which all of them share). A centroid whose interval begins above the lowest upper end is
out; where one is left, the vector is assigned by its cells alone. Only where intervals overlap is
the vector itself compared, with the centroids that are left, in exact integers.

The folder is cut into blocks by the margin of the first assignment. A later round scans the cells,
learns which blocks hold vectors that need a look or have moved, and reads vectors from these blocks
only; sums of the centroids change by the vectors that moved. Nothing else goes to the driver than
centroids, tables of cells and one row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebound.llm.batches import removed_folder, shared
from tracebound.llm.tokens import shared_folder
from tracebound.plans.lineage import cut

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
BITS = 6
#: Components are held within these bounds, so that a distance fits in 64 bits.
LARGEST = 1 << 27
#: Blocks, by the margin of the first assignment, and how many there are to the width of an interval.
MARGINS, STEPS = 16, 6
#: Vectors that are compared together.
ROWS = 4096


@dataclass
class Cells:
    """Per dimension the lowest and highest value of each cell."""

    edges: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, mean, spread, least, most, bits: int = BITS) -> Cells:
        """Cells between the quantiles of a normal distribution with these moments."""
        cuts = np.array([NormalDist().inv_cdf(k / 2 ** bits) for k in range(1, 2 ** bits)])
        edges, low, high = [], [], []
        for m, s, a, b in zip(mean, spread, least, most):
            inner = np.floor(m + s * cuts).astype(np.int64)
            inner = np.unique(inner[(inner > a) & (inner <= b)])
            edges.append(inner)
            gap = 2 ** bits - 1 - len(inner)
            low.append(np.concatenate([[a], inner, np.zeros(gap)]))
            high.append(np.concatenate([inner - 1, [b], np.zeros(gap)]))
        return cls(edges, np.array(low, float), np.array(high, float))

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, vectors[:, j], "right") for j, e in enumerate(self.edges)],
                        axis=1).astype(np.uint8)

    def intervals(self, cells: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the distance to every centroid, less the distance to the centroids' mean."""
        dims = np.arange(cells.shape[1])
        low, high = self.low[dims, cells], self.high[dims, cells]
        mean = centroids.mean(axis=0)
        slope = (centroids - mean).T
        shift = ((centroids - mean) * (centroids + mean)).sum(axis=1)
        middle = shift - (low + high) @ slope
        # wider by what rounding may have moved it
        width = (high - low) @ abs(slope) + 1e-9 * (1 + abs(middle) + (abs(low) + abs(high)) @ abs(slope))
        return middle - width, middle + width


def nearest(cells: np.ndarray, table: Cells, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid by cells alone or -1, which centroids are left)."""
    low, high = table.intervals(cells, centroids)
    left = low <= high.min(axis=1)[:, None]
    return np.where(left.sum(axis=1) == 1, left.argmax(axis=1), -1), left


def distances(vectors: np.ndarray, centroids: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Exact squared distances to the centroids that are left; the others are beyond reach."""
    out = np.full(left.shape, np.iinfo(np.int64).max)
    for c in np.flatnonzero(left.any(axis=0)):
        rows = np.flatnonzero(left[:, c])
        gap = vectors[rows].astype(np.int64) - centroids[c]
        out[rows, c] = (gap * gap).sum(axis=1)
    return out


def assigned(cells: np.ndarray, vectors: Callable[[np.ndarray], np.ndarray], table: Cells,
             centroids: np.ndarray) -> np.ndarray:
    """Nearest centroid of every row, the smaller number in a tie; ``vectors(rows)`` fetches some rows."""
    number, left = nearest(cells, table, centroids)
    rows = np.flatnonzero(number < 0)
    if len(rows):
        number[rows] = distances(vectors(rows), centroids, left[rows]).argmin(axis=1)
    return number


def as_matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def integers(vectors: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """``key`` and the components times ``scale``, floored, as packed 32-bit integers; others are dropped."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("vector")
            flat = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
            good = np.isfinite(flat).all(axis=1)
            whole = np.clip(np.floor(scale * flat[good]), -LARGEST, LARGEST).astype("<i4")
            yield pa.record_batch([
                batch.column("key").filter(pa.array(good)), pa.array([w.tobytes() for w in whole], pa.binary()),
            ], names=["key", "vector"])

    kind = vectors.schema[key].dataType.simpleString()
    value = F.col(vector)
    return (
        vectors.select(F.col(key).alias("key"), value.alias("vector"))
        .filter((F.size("vector") == size) & ~F.exists("vector", lambda x: x.isNull()))
        .mapInArrow(packed, f"key {kind}, vector binary")
    )


def moments(whole: DataFrame, size: int) -> tuple[np.ndarray, ...]:
    """Mean, spread, least and largest value per dimension over all vectors."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(size), np.zeros(size)
        least, most = np.full(size, LARGEST), np.full(size, -LARGEST)
        for batch in batches:
            if batch.num_rows:
                x = as_matrix(batch.column("vector"), "<i4", size).astype(float)
                n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
                least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            yield pa.record_batch([
                pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(total),
                pa.array(squares), pa.array(least, pa.float64()), pa.array(most, pa.float64()),
            ], names=["j", "n", "total", "squares", "least", "most"])

    rows = (
        whole.select("vector")
        .mapInArrow(partial, "j int, n bigint, total double, squares double, least double, most double")
        .groupBy("j").agg(F.sum("n"), F.sum("total"), F.sum("squares"), F.min("least"), F.max("most"))
        .orderBy("j").collect()
    )
    _, n, total, squares, least, most = np.array(rows, float).T
    mean = total / n
    return mean, np.sqrt(np.maximum(squares / n - mean ** 2, 1e-6)), least, most


def summed(changes: DataFrame, clusters: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the clusters from rows (cluster, j, value); ``j`` = -1 holds counts."""
    counts, sums = np.zeros(clusters, object), np.zeros((clusters, size), object)
    for cluster, j, value in changes.groupBy("cluster", "j").agg(F.sum("value")).collect():
        if j < 0:
            counts[cluster] = int(value)
        else:
            sums[cluster, j] = int(value)
    return counts, sums


def change_rows(counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Non-zero counts and sums as rows for ``summed``."""
    table = np.concatenate([counts[:, None], sums], axis=1)
    cluster, j = np.nonzero(table)
    return pa.record_batch([
        pa.array(cluster, pa.int32()), pa.array(j - 1, pa.int32()), pa.array(table[cluster, j], pa.int64()),
    ], names=["cluster", "j", "value"])


CHANGES = "cluster int, j int, value bigint"


def moved_centroids(centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    out = centroids.copy()
    for c in np.flatnonzero(counts > 0):
        out[c] = [int(s) // int(counts[c]) for s in sums[c]]
    return out


def first_centroids(whole: DataFrame, clusters: int, seed: int, size: int) -> np.ndarray:
    """The vectors with the smallest hash of seed and key; equal hashes by the vector."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    rows = whole.select(F.sha2(name, 256).alias("h"), "vector").orderBy("h", "vector").limit(clusters).collect()
    return np.array([np.frombuffer(bytes(r.vector), "<i4") for r in rows], np.int64).reshape(-1, size)


def write_file(whole: DataFrame, path: str, table: Cells, centroids: np.ndarray, size: int) -> None:
    """Write key, cells and vector in blocks by the margin of the first assignment."""
    spark = whole.sparkSession
    sent = shared(spark, (table, centroids))
    kind = whole.schema["key"].dataType.simpleString()

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, centroids = sent()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = as_matrix(part.column("vector"), "<i4", size)
                cells = table.encode(vectors)
                low, high = table.intervals(cells, centroids)
                middle = np.sort((low + high) / 2, axis=1)
                # how far the second is behind the first, in widths of an interval
                behind = middle[:, min(1, len(centroids) - 1)] - middle[:, 0]
                margin = np.minimum(np.floor(behind / (high - low).mean(axis=1) * STEPS), MARGINS - 1)
                yield pa.record_batch([
                    part.column("key"), pa.array([c.tobytes() for c in cells], pa.binary()),
                    part.column("vector"), pa.array(margin.astype(int), pa.int32()),
                ], names=["key", "cells", "vector", "block"])

    rows = whole.mapInArrow(laid, f"key {kind}, cells binary, vector binary, block int")
    # a block of any size is split over as many tasks as it needs
    rows.hint("rebalance", "block").write.partitionBy("block").parquet(path)


def first_sums(file: DataFrame, table: Cells, centroids: np.ndarray, size: int) -> DataFrame:
    """Counts and sums of all vectors by their nearest centroid."""
    sent = shared(file.sparkSession, (table, centroids))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, centroids = sent()
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = as_matrix(part.column("vector"), "<i4", size)
                number = assigned(as_matrix(part.column("cells"), np.uint8, size),
                                  vectors.__getitem__, table, centroids)
                counts += np.bincount(number, minlength=len(centroids))
                for c in np.unique(number):
                    sums[c] += vectors[number == c].sum(axis=0, dtype=np.int64)
        yield change_rows(counts, sums)

    return file.select("cells", "vector").mapInArrow(counted, CHANGES)


def blocks_to_read(file: DataFrame, table: Cells, before: np.ndarray, now: np.ndarray, size: int) -> list[int]:
    """Blocks in which a vector's cells leave its centroid open, or show that it has changed."""
    sent = shared(file.sparkSession, (table, before, now))

    def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before, now = sent()
        found: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                block = part.column("block").to_numpy()
                cells = as_matrix(part.column("cells"), np.uint8, size)[~np.isin(block, list(found))]
                block = block[~np.isin(block, list(found))]
                old, new = (nearest(cells, table, c)[0] for c in (before, now))
                found.update(block[(old < 0) | (new < 0) | (old != new)].tolist())
        yield pa.record_batch([pa.array(sorted(found), pa.int32())], names=["block"])

    rows = file.select("block", "cells").mapInArrow(open_rows, "block int").distinct()
    return [r.block for r in rows.collect()]


def changed_sums(file: DataFrame, table: Cells, before: np.ndarray, now: np.ndarray, size: int) -> DataFrame:
    """What the vectors that changed their centroid add to one and take from the other."""
    sent = shared(file.sparkSession, (table, before, now))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before, now = sent()
        counts, sums = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                cells, column = as_matrix(part.column("cells"), np.uint8, size), part.column("vector")

                def fetched(rows):
                    return as_matrix(column.take(pa.array(rows)), "<i4", size)

                old, new = (assigned(cells, fetched, table, c) for c in (before, now))
                rows = np.flatnonzero(old != new)
                if len(rows):
                    vectors = fetched(rows).astype(np.int64)
                    for number, sign in ((new[rows], 1), (old[rows], -1)):
                        counts += sign * np.bincount(number, minlength=len(now))
                        np.add.at(sums, number, sign * vectors)
        yield change_rows(counts, sums)

    return file.select("cells", "vector").mapInArrow(moved, CHANGES)


def final_rows(file: DataFrame, table: Cells, centroids: np.ndarray, size: int, kind: str) -> DataFrame:
    """Key, cluster and exact distance of every vector."""
    sent = shared(file.sparkSession, (table, centroids))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, centroids = sent()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = as_matrix(part.column("vector"), "<i4", size)
                number = assigned(as_matrix(part.column("cells"), np.uint8, size),
                                  vectors.__getitem__, table, centroids)
                gap = vectors - centroids[number]
                yield pa.record_batch([
                    part.column("key"), pa.array(number, pa.int32()), pa.array((gap * gap).sum(axis=1), pa.int64()),
                ], names=["key", "cluster", "distance"])

    return file.select("key", "cells", "vector").mapInArrow(measured, f"key {kind}, cluster int, distance bigint")


def centroid_clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                      clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = DIMENSIONS,
                      scale: int = SCALE, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """k-means with integer centroids over ``vectors(key, vector)``.

    Returns one row per kept vector: the key, cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256. Null vectors and vectors of another length or with a null or non-finite component
    are dropped; components beyond ``LARGEST`` count as that bound. Repeated rows are vectors of their
    own; a null key counts as the empty text in the first choice; ties go to the smaller number; with
    fewer vectors than clusters there are fewer clusters; an empty table stays empty. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    whole = integers(vectors, key, vector, size, scale)
    kind = vectors.schema[key].dataType.simpleString()
    centroids = first_centroids(whole, clusters, seed, size)
    if not len(centroids):
        schema = (f"`{key}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, "
                  "centroid_sha256 string")
        return spark.createDataFrame([], schema)
    table = Cells.of(*moments(whole, size), bits)
    path = shared_folder(spark, "va-file")
    write_file(whole, path, table, centroids, size)
    file = spark.read.parquet(path)
    counts, sums = summed(first_sums(file, table, centroids, size), len(centroids), size)
    for k in range(rounds):
        if k:
            wanted = blocks_to_read(file, table, before, centroids, size)  # noqa: F821
            more = summed(changed_sums(file.filter(F.col("block").isin(wanted)), table, before, centroids, size),
                          len(centroids), size) if wanted else (0, 0)
            counts, sums = counts + more[0], sums + more[1]
        before, centroids = centroids, moved_centroids(centroids, counts, sums)
    rows = cut(final_rows(file, table, centroids, size, kind))
    removed_folder(spark, path)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # one row per cluster
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    own = {r.cluster: min(int(r.d), 2 ** 63 - 1) for r in inertia}
    total = min(sum(int(r.d) for r in inertia), 2 ** 63 - 1)
    return rows.select(
        F.col("key").alias(key), "cluster", "distance",
        F.element_at(F.array(*[F.lit(own.get(c, 0)).cast("bigint") for c in range(len(digests))]),
                     F.col("cluster") + 1).alias("cluster_inertia"),
        F.lit(total).cast("bigint").alias("inertia"),
        F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1).alias("centroid_sha256"))
