"""Helpers of the operators: written tables, Arrow text as numpy bytes, word hashes, splits, cuts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskflow.session import shared_dir

#: Texts are handled in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_bytes = np.arange(256)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: The bytes of WORD_PATTERN after A-Z are lower-cased; every byte of a longer code point is one.
IN_WORD = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
_FACTORS = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


#: Paths that `materialize` wrote inside the innermost `scratch`; None outside of any.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialize` writes inside are removed at the end, also after an error.

    What is to outlive them must be written inside by other means, since plans over these tables can't run later.
    """
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        remove(spark, paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes written tables, on whatever file system the shared folder is; one that is gone already is no error."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{name}")
    if (paths := _written.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents whose labels are never learnt from; a null id is not held out."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return crc % 4 == 2


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets): no Python strings are made. Null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0]:at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `most` bytes of text each."""
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES):
    """(rows of a batch, their bytes, their offsets) for every block of every batch."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        for a, b in row_blocks(offsets, most):
            yield batch.slice(a, b - a), data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, inverse = 1 << bits, pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of any byte spans of one block, from a running polynomial sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(max(20, int(len(data) + 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_FACTORS[data] * up[:len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the words of lower-cased bytes, and the offsets of each text's words."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = IN_WORD[data]
    start = inside[:-1].copy()
    start[1:] &= ~inside[:-2]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    stop = inside[:-1] & ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stop[last] = inside[last]
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of each text's words) after A-Z are lower-cased."""
    data = LOWER[data]
    start, end, at = word_spans(data, offsets)
    return SpanHasher(data)(start, end), at


def cut_points(df: DataFrame, column: str, parts: int, weight: Column | None = None) -> list[int]:
    """Values that cut the integer `column` into ranges of about equal weight, the same for the same rows.

    Exact histograms, refined inside ranges that are still too heavy; only counts reach the driver,
    a few for each part. A single heavy value stays whole.
    Null values are left to the caller.
    """
    w = (F.lit(1) if weight is None else weight).cast("long")
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("v"), w.alias("w"))
    low, high, total = rows.agg(F.min("v"), F.max("v"), F.sum("w")).first()
    if low is None or parts < 2 or not total:
        return []
    most, bins = max(1, total // parts), max(4096, 4 * parts)
    counted: list[tuple[int, int, int]] = []
    open_ranges = [(low, high)]
    while open_ranges:
        heavy: list[tuple[int, int]] = []
        for a, b in open_ranges:
            width = -(-(b - a + 1) // bins)
            each = rows.filter(F.col("v").between(a, b)).groupBy(F.expr(f"(v - {a}L) div {width}L").alias("bin")).agg(F.sum("w").alias("w"))
            for r in each.collect():
                x, y = a + r["bin"] * width, min(b, a + (r["bin"] + 1) * width - 1)
                (heavy if r["w"] > most and y > x else counted).append((x, y) if r["w"] > most and y > x else (x, y, r["w"]))
        open_ranges = heavy
    cuts, run = [], 0
    for x, _, n in sorted(counted):
        if run and run + n > most:
            cuts.append(x)
            run = 0
        run += n
    return cuts


#: Ranges that a table is cut into at most; larger tables get larger ranges.
MOST_RANGES = 20_000


def range_of(column: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the value: 0 .. len(cuts); null for null. Found in two steps of about 128 comparisons."""
    array = lambda values: F.from_json(F.lit(str(values)), "array<bigint>")
    upto = lambda values: F.size(F.filter(values, lambda c: c <= column))
    if not cuts:
        return F.when(column.isNotNull(), F.lit(0))
    if len(cuts) <= 128:
        return F.when(column.isNotNull(), upto(array(cuts)))
    coarse = F.greatest(upto(array(cuts[::128])) - 1, F.lit(0))
    return F.when(column.isNotNull(), coarse * 128 + upto(F.slice(array(cuts), coarse * 128 + 1, 128)))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of the graph of edges (a, b): root is the smallest node of its component.

    Labels sink along edges and are then replaced by their label's label, so the rounds follow the
    logarithm of the longest path. Every round is a written table; only a count of changes reaches the driver.
    """
    both = materialize(
        edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        sunk = labels.join(seen.select(F.col("a").alias("node"), "low"), "node", "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("low", "root")).alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        labels_next = materialize(
            sunk.join(up, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("root"),
                                                 (F.least("mid", F.coalesce("far", "mid")) != F.col("old")).alias("moved")),
            f"{name}-{step}")
        moved = labels_next.filter("moved").limit(1).count()
        labels = labels_next.select("node", "root")
        if not moved:
            return labels
