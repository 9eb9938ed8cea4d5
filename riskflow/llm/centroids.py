"""Centroid clustering of integer vectors over a vector-approximation file.

Every vector is kept twice in one written table: whole, and as cells of a few bits a dimension, whose borders are
quantiles of the dimension. For a centroid a lookup table gives the least and the greatest share in the distance that
a cell allows; summed over the dimensions they enclose the distance. Only centroids whose interval reaches below
the smallest upper end can be the nearest: where one is left it is, without a look at the whole vector; where
several are left the whole vector decides among them, exactly, in integers.

A round is one pass without a shuffle: tasks add up the vectors of each cluster, k x dimensions numbers a task.
Only borders, sums and centroids reach the driver. Their size follows k and the dimensions, not the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskflow.llm.common import materialize

#: Whole components beyond this count as this: squared distances of up to 256 dimensions stay below 2^63.
MOST = 1 << 27
#: Rows whose distance intervals are held at a time.
BLOCK = 4096


@dataclass
class Clustering:
    """The assignment (vec_id, cluster, distance, compared) and the centroids it was made with."""

    assigned: DataFrame
    centroids: list[list[int]]


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and embedding of the rows with exactly `dims` components, none of them null or non-finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("embedding").isNotNull() & (F.size("embedding") == dims) & finite)


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and vec: the components times scale, rounded down; beyond MOST they are MOST."""
    def component(x):
        return F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(2.0**40)), F.lit(-(2.0**40))) * scale), F.lit(MOST)), F.lit(-MOST))

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", component).cast("array<int>").alias("vec"))


def borders(table: DataFrame, dims: int, bits: int) -> np.ndarray:
    """dims x (cells + 1) whole numbers: cell j holds the numbers from border j up to, not with, border j + 1."""
    shares = [j / (1 << bits) for j in range((1 << bits) + 1)]
    at = [F.col("vec")[d] for d in range(dims)]
    row = table.agg(*[F.percentile_approx(c, shares, 1000) for c in at], *[F.min(c) for c in at], *[F.max(c) for c in at]).first()
    marks = np.array([row[d] for d in range(dims)], np.int64).reshape(dims, -1)
    marks[:, 0], marks[:, -1] = row[dims:2 * dims], np.array(row[2 * dims:], np.int64) + 1
    return np.maximum.accumulate(marks, axis=1)


def pairs_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(even, odd) dimensions, which share a number and a lookup; an odd last dimension is paired with cell 0."""
    if cells.shape[1] % 2:
        cells = np.pad(cells, ((0, 0), (0, 1)))
    return cells[:, ::2], cells[:, 1::2]


def tables_of(centroids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) share in the distance: pairs of dimensions x pairs of cells x centroids.

    Taken from each distance is the one to a point amid the centroids. It is the same for all of them, so the order
    stays, and the intervals get far narrower: what is left, c^2 - m^2 - 2 x (c - m), is linear in x.
    """
    middle = centroids.sum(axis=0) // len(centroids)
    rest, slope = (centroids**2 - middle**2).T[:, None, :], 2 * (centroids - middle).T[:, None, :]
    low, high = marks[:, :-1, None], np.maximum(marks[:, 1:, None] - 1, marks[:, :-1, None])
    at_low, at_high = rest - low * slope, rest - high * slope
    both = []
    for table in (np.minimum(at_low, at_high), np.maximum(at_low, at_high)):
        if len(table) % 2:
            table = np.concatenate([table, np.zeros_like(table[:1])])
        n = table.shape[1]
        both.append((table[::2, :, None, :] + table[1::2, None, :, :]).reshape(len(table) // 2, n * n, -1))
    return both[0], both[1]


def nearest(vec: np.ndarray, cells: np.ndarray, centroids: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, number of centroids that the whole vector was compared with) of every row.

    Ties go to the smaller number: equal distances keep both centroids in the running, and the exact comparison
    takes the first.
    """
    lower = np.zeros((len(cells), len(centroids)), np.int64)
    upper = np.zeros_like(lower)
    for pair in range(cells.shape[1]):
        lower += least[pair, cells[:, pair]]
        upper += most[pair, cells[:, pair]]
    open_ = lower <= upper.min(axis=1, keepdims=True)
    several = open_.sum(axis=1)
    cluster = open_.argmax(axis=1)
    rows = np.flatnonzero(several > 1)
    exact = np.full((len(rows), len(centroids)), np.iinfo(np.int64).max)
    for k, c in enumerate(centroids):
        at = np.flatnonzero(open_[rows, k])
        exact[at, k] = ((vec[rows[at]] - c) ** 2).sum(axis=1)
    cluster[rows] = exact.argmin(axis=1)
    return cluster, np.where(several > 1, several, 0)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, half: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            vec = part.column("vec").flatten().to_numpy().reshape(-1, dims).astype(np.int64)
            cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint16).reshape(-1, half)
            yield part, vec, cells


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, bits: int = 5, seed: int = 1) -> Clustering:
    """k clusters of the vectors after `rounds` rounds: vec_id, cluster, distance (squared), compared.

    vectors: vec_id, embedding (array of float or double); other columns are passed over. Rows with another number
    of components, or with null or non-finite ones, take no part. The others are multiplied by scale and rounded
    down. The first centroids are the k vectors with the smallest sha256 of `seed:vec_id`, ties by their
    components; with fewer vectors there are fewer centroids. A null vec_id hashes as an empty text and stays null.
    A row that repeats counts, and comes back, as often as it is there. An empty cluster keeps its centroid.
    Equal distances go to the smaller number. `compared` is the number of centroids that the whole vector was
    compared with, 0 where the cells decided. An empty table gives an empty result.
    """
    if not 1 <= bits <= 8:
        raise ValueError("bits must be 1 to 8")
    spark = vectors.sparkSession
    integers = materialize(whole(kept(vectors, dims), scale), "centroids-vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = integers.select(key.alias("key"), "vec").orderBy("key", "vec").limit(k).collect()  # k rows
    if not first:
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long, compared int"), [])
    marks, n, half = borders(integers, dims, bits), 1 << bits, (dims + 1) // 2

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec").flatten().to_numpy().reshape(-1, dims)
            cells = np.stack([np.clip(np.searchsorted(marks[d], vec[:, d], "right") - 1, 0, n - 1) for d in range(dims)], axis=1)
            a, b = pairs_of(cells)
            packed = (a * n + b).astype(np.uint16)
            data = pa.Array.from_buffers(pa.binary(2 * half), len(packed), [None, pa.py_buffer(np.ascontiguousarray(packed))])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), data.cast(pa.binary())], ["vec_id", "vec", "cells"])

    table = materialize(integers.mapInArrow(approximate, "vec_id long, vec array<int>, cells binary"), "centroids-cells")
    centroids = [list(r["vec"]) for r in first]

    def sums(points: list[list[int]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = np.array(points, np.int64)
            least, most = tables_of(c, marks)
            total, count = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
            for _, vec, cells in _blocks(batches, dims, half):
                own, _ = nearest(vec, cells, c, least, most)
                order = np.argsort(own, kind="stable")
                there, at = np.unique(own[order], return_index=True)
                total[there] += np.add.reduceat(vec[order], at, axis=0)
                count += np.bincount(own, minlength=len(c))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(some, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(some))),
                 pa.array(total[some].ravel()), pa.array(np.repeat(count[some], dims))], ["cluster", "dim", "total", "n"])

        return table.mapInArrow(run, "cluster int, dim int, total long, n long").groupBy("cluster", "dim").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))

    for _ in range(rounds):
        for r in sums(centroids).collect():  # k x dims rows
            centroids[r["cluster"]][r["dim"]] = int(r["total"]) // r["n"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        least, most = tables_of(c, marks)
        for part, vec, cells in _blocks(batches, dims, half):
            own, compared = nearest(vec, cells, c, least, most)
            distance = ((vec - c[own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(distance), pa.array(compared.astype(np.int32))],
                ["vec_id", "cluster", "distance", "compared"])

    return Clustering(materialize(table.mapInArrow(assign, "vec_id long, cluster int, distance long, compared int"), "centroids-assigned"), centroids)


def inertia(clustering: Clustering) -> DataFrame:
    """The assignment with cluster_inertia and inertia (distance summed over its cluster and over all; null where a
    sum is no long) and centroid_sha256, of the final centroid's components as decimal numbers joined by commas."""
    spark = clustering.assigned.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in clustering.assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    fits = lambda v: v if v < 1 << 63 else None
    rows = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, clustering.centroids[c])).encode()).hexdigest())
            for c, s in sums.items()]
    # A row a cluster: small enough to send to every task.
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustering.assigned.join(F.broadcast(named), "cluster")
