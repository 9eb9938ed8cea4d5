"""Approximate nearest neighbours by largest inner product: randomly rotated one-bit codes.

A unit vector is turned by a random rotation and kept as its signs, with two scalars: its length and
the inner product of the turned vector with its signs. They estimate any inner product without bias,
and bound the estimate's error with high probability. A search estimates from the packed bits,
computes the best few exactly, and then every vector whose bound still reaches the k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskflow.llm.common import materialize

#: Width of the error bound in its own deviations: 2.5 leaves about one in a hundred outside on either side.
BOUND = 2.5
#: Rows and queries that one task holds together: 20 MB of 64 components. Of N rows and Q queries N x Q / QUERY_BLOCK +
#: N x Q / ROW_BLOCK vectors are sent.
ROW_BLOCK, QUERY_BLOCK = 32_768, 8192
_SIGNS = (2.0 * ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1) - 1).T.astype(np.float32)  # [8, 256], as packbits orders bits


@cache
def rotation(dim: int, seed: int = 17) -> np.ndarray:
    """The same random rotation for a dimension everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, dim of the rows that take part: an id, and a vector that is not null, empty or
    zero and has no null or non-finite component."""
    e = F.col("embedding")
    whole = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & e.isNotNull()).filter(whole).withColumn("dim", F.size("embedding"))


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths) of rows without zero vectors, of any size that a double has: no square overflows or vanishes."""
    largest = np.abs(x).max(axis=1, keepdims=True)
    unit = x / largest
    length = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    return unit / length, (largest * length)[:, 0]


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, lengths, inner products of turned unit vector and signs) of the rows of x."""
    unit, length = units(x)
    turned = unit @ rotation(x.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column(2).to_numpy(zero_copy_only=False)
        vectors = batch.column(1).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = np.stack([vectors[i] for i in at]).astype(np.float64)
            codes, length, fit = encode(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(np.full(len(at), dim, np.int32)),
                pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(fit)], ["vec_id", "vector", "dim", "code", "length", "fit"])


def index(vectors: DataFrame) -> DataFrame:
    """The written index of every usable row: vec_id, vector (doubles), dim, code, length, fit."""
    return materialize(usable(vectors).mapInArrow(
        _coded, "vec_id long, vector binary, dim int, code binary, length double, fit double"), "ann-index")


def nearest(query: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, length: np.ndarray, fit: np.ndarray,
            k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, exact scores) of the best k rows found, leaving out rows of the query's own id."""
    # Scores are compared for the unit query: its length changes no order.
    dim, unit = len(query), units(query[None])[0][0]
    turned = np.zeros(8 * codes.shape[1], np.float32)
    turned[:dim] = unit @ rotation(dim)
    table = turned.reshape(-1, 8) @ _SIGNS
    raw = table[0][codes[:, 0]]
    for b in range(1, codes.shape[1]):
        raw += table[b][codes[:, b]]
    estimate = length * (raw / (np.sqrt(dim) * fit))
    error = length * (np.sqrt(np.maximum(0, 1 - fit * fit)) / fit * bound / np.sqrt(max(1, dim - 1)) + 1e-5)  # the table is single precision
    estimate[ids == own] = -np.inf
    exact = lambda rows: (x[rows] * unit).sum(axis=1)
    first = np.argpartition(-estimate, min(2 * k, len(ids)) - 1)[:2 * k]
    first = first[ids[first] != own]
    least = np.sort(exact(first))[-k] if len(first) >= k else -np.inf
    rows = np.flatnonzero((estimate + error >= least) & (ids != own))
    rows = np.union1d(rows, first)
    score = (x[rows] * query).sum(axis=1)  # row by row, so equal vectors score alike
    order = np.lexsort((ids[rows], -score))[:k]
    return rows[order], score[order]


def _search(k: int, bound: float):
    def search(table: pa.Table) -> pa.Table:
        asked = table.column("asked").to_numpy()
        ids = table.column("vec_id").to_numpy()
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)
        rows, queries = np.flatnonzero(~asked), np.flatnonzero(asked)
        out: list[list] = [[], [], []]
        if len(rows) and len(queries):
            codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[rows]
            length, fit = (table.column(c).to_numpy()[rows] for c in ("length", "fit"))
            x, names = vectors[rows], ids[rows]
            for q in queries:
                found, score = nearest(vectors[q], ids[q], names, x, codes, length, fit, k, bound)
                out[0].append(np.full(len(found), ids[q]))
                out[1].append(names[found])
                out[2].append(score)
        flat = [np.concatenate(v) if v else np.zeros(0) for v in out]
        return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "vec_id": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(np.float64))})

    return search


def search(coded: DataFrame, queries: DataFrame, k: int = 20, bound: float = BOUND,
           row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, ties to the smaller vec_id.

    `coded` is an index, `queries` rows of one (a repeated id asks once). All rows are compared, in blocks of
    rows by queries; vectors of another dimension than the query's are no candidates. Fewer than k
    candidates give fewer rows, an empty table none. Rows that repeat are candidates as often as they come.
    """
    rows, asked = coded.count(), queries.count()
    n, m = max(1, -(-rows // row_block)), max(1, -(-asked // query_block))
    once = queries.groupBy("vec_id").agg(F.min(F.struct("dim", "vector", "code", "length", "fit")).alias("q")).select("vec_id", "q.*")
    # By the row's own number: rows that repeat an id, or repeat as a whole, go to different blocks.
    deal = lambda blocks: F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(blocks)).cast("int")
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    columns = ["dim", "i", "j", "asked", "vec_id", "vector", "code", "length", "fit"]
    left = coded.withColumn("asked", F.lit(False)).withColumn("i", deal(n)).withColumn("j", spread(m)).select(*columns)
    right = once.withColumn("asked", F.lit(True)).withColumn("j", F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")).withColumn("i", spread(n)).select(*columns)
    found = left.union(right).groupBy("dim", "i", "j").applyInArrow(_search(k, bound), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
