"""N-gram Jaccard join: Bayesian pruning over MinHash values read bit by bit, the rest verified exactly.

Texts are sets of hashed five-word shingles. Equal sets are one node. Bands of the MinHash values link
nodes to the first of their bucket; the components of those links hold every candidate pair, and inside
them all pairs are compared in blocks: 32 values at a time, dropping a pair once the posterior
probability of a Jaccard of at least the threshold is below the tolerance. Pairs that are left
are counted on their shingles. No pair becomes a row: a block returns counts and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskflow.llm.common import SpanHasher, components, materialize, mix, text_blocks, words_of

WORDS = 5
THRESHOLD = 0.8
#: 32 bands of 5 values: a pair at 0.8 meets in none of them with a probability of 3e-6.
BANDS, BAND_ROWS = 32, 5
VALUES = BANDS * BAND_ROWS
FIRST_BANDS = 4
STEP = 32
TOLERANCE = 1e-6
#: Bytes of shingles in one block of a large group.
BLOCK_SHINGLES = 4 << 20

_rng = np.random.default_rng(5)
_SHINGLE = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_MULTIPLY = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_BAND_SEED = _rng.integers(1, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text.

    A text of one to four words is one shingle; a text without words is one shingle of all its bytes,
    so that only equal ones match.
    """
    words, at = words_of(data, offsets)
    n = max(0, len(words) - WORDS + 1)
    rolled = mix(sum((words[k:k + n] * _SHINGLE[k] for k in range(WORDS)), np.zeros(n, np.uint64)))
    whole = None
    out = []
    for i in range(len(offsets) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= WORDS:
            out.append(np.unique(rolled[a:b - WORDS + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * _SHINGLE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            whole = whole or SpanHasher(data)
            out.append(whole(offsets[i:i + 1], offsets[i + 1:i + 2], 99))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 512):
        np.minimum(low, (np.multiply.outer(_MULTIPLY, shingles[a:a + 512]) + _ADD[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def set_name(shingles: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    a = mix(shingles).sum(dtype=np.uint64)
    b = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return np.array([a, b], ">u8").tobytes()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches):
        sets = shingle_sets(data, offsets)
        yield pa.RecordBatch.from_arrays([
            rows.column(0), rows.column(1), pa.array([set_name(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([minhash(s).tobytes() for s in sets], pa.binary())], ["doc_id", "th", "node", "size", "sig"])


def _near(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """Edges (a, b) from each node to the smallest node of its buckets, by the bands first .. last - 1.

    Nodes that share name and band are one row before anything is joined.
    """

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(batch), BANDS, BAND_ROWS)[:, first:last].astype(np.uint64)
            keys = mix((sig * _BAND_SEED[first:last]).sum(axis=2, dtype=np.uint64) + np.arange(first, last, dtype=np.uint64)).view(np.int64)
            names = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), last - first)))
            yield pa.RecordBatch.from_arrays([names, pa.array(keys.ravel())], ["node", "band"])

    bands = nodes.select("node", "sig").mapInArrow(banded, "node binary, band long").distinct()
    centres = bands.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return bands.join(centres, "band").filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches):
        sets = pa.array([s.tobytes() for s in shingle_sets(data, offsets)], pa.binary())
        yield pa.RecordBatch.from_arrays([*rows.columns[:4], sets], ["node", "root", "blocks", "block", "shingles"])


def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """Fewest equal values of n at which P(Jaccard >= threshold) reaches the tolerance, from a flat prior.

    The posterior is a beta distribution; its tail is a binomial sum for whole numbers.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def surviving_pairs(a: np.ndarray, b: np.ndarray, own: bool, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs that no step drops. own: a is b, and each pair counts once."""
    done, need = least[0]
    equal = np.zeros((len(a), len(b)), np.uint8)
    for k in range(done):
        equal += a[:, k, None] == b[None, :, k]
    keep = equal >= need
    if own:
        keep = np.triu(keep, 1)
    x, y = np.nonzero(keep)
    matched = equal[x, y].astype(np.int32)
    for n, need in least[1:]:
        for p in range(0, len(x), 1 << 16):
            q = slice(p, p + (1 << 16))
            matched[q] += (a[x[q], done:n] == b[y[q], done:n]).sum(axis=1)
        keep = matched >= need
        x, y, matched, done = x[keep], y[keep], matched[keep], n
    return x, y


def verified(sets_a: list[np.ndarray], sets_b: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair (x[i], y[i]), sorted by x, reaches the threshold on its shingles."""
    good = np.zeros(len(x), bool)
    cuts = np.flatnonzero(np.diff(x, prepend=-1, append=-2))
    for p, q in zip(cuts[:-1], cuts[1:]):
        own = sets_a[x[p]]
        others = [sets_b[j] for j in y[p:q]]
        sizes = np.array([len(s) for s in others])
        flat = np.concatenate(others)
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.add.reduceat((own[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[:-1])]))
        good[p:q] = common >= threshold * (len(own) + sizes - common) - 1e-9
    return good


def _compare(threshold: float, tolerance: float):
    least = [(n, least_matches(threshold, tolerance, n)) for n in range(STEP, VALUES + 1, STEP)]

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        rows: dict[bytes, tuple] = {}
        for node, block, shingles in zip(*(table.column(c).to_pylist() for c in ("node", "block", "shingles"))):
            rows[node] = (block, np.frombuffer(shingles, np.uint64))
        names = sorted(rows)
        sets = [rows[n][1] for n in names]
        sig = np.stack([minhash(s) for s in sets])
        if i == j:
            left = right = np.arange(len(names))
        else:
            side = np.array([rows[n][0] for n in names])
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        links, root = np.zeros(len(names), np.int64), np.arange(len(names))
        if len(left) and len(right):
            x, y = surviving_pairs(sig[left], sig[right], i == j, least)
            good = verified([sets[k] for k in left], [sets[k] for k in right], x, y, threshold)
            x, y = left[x[good]], right[y[good]]
            np.add.at(links, x, 1)
            np.add.at(links, y, 1)
            while True:  # the smallest number sinks along the links
                low = root.copy()
                np.minimum.at(low, x, root[y])
                np.minimum.at(low, y, root[x])
                low = low[low]
                if (low == root).all():
                    break
                root = low
        on = np.flatnonzero(links)
        return pa.table({"node": pa.array([names[k] for k in on], pa.binary()), "links": pa.array(links[on]),
                         "root": pa.array([names[root[k]] for k in on], pa.binary())})

    return compare


def classify(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row a row of docs: doc_id, th (hash of the text), class_node, class_id, n_links, n_copies, keeper.

    class_id is the smallest doc_id linked to the row directly or over others, n_links the number of
    other distinct shingle sets at or above the threshold, n_copies the rows with its very set, itself
    included. keeper marks the rows that stay if each class keeps one text: those of its smallest
    doc_id, then text hash; nulls come last. A null text counts as empty; empty texts are copies of
    each other. A null doc_id is kept as it is. An empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("th", F.xxhash64("text"))
    signed = materialize(
        keyed.select("doc_id", "th", "text").mapInArrow(_signed, "doc_id long, th long, node binary, size long, sig binary"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    nodes = materialize(
        signed.groupBy("node").agg(first.alias("first"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("sig").alias("sig")), "nodes")

    # A few bands join what is most alike; the rest only has to join those groups with each other.
    alike = components(_near(nodes, 0, FIRST_BANDS), "alike")
    grouped = nodes.select("node", "sig").join(alike, "node", "left").select(F.coalesce("root", "node").alias("node"), "sig")
    further = components(_near(grouped, FIRST_BANDS, BANDS), "further")
    both = alike.select("node", F.col("root").alias("near")).union(further.select("node", F.col("node").alias("near"))).groupBy("node").agg(F.min("near").alias("near"))
    groups = both.join(further.select(F.col("node").alias("near"), "root"), "near", "left").select("node", F.coalesce("root", "near").alias("root"))
    groups = materialize(groups, "groups")

    # About 2 sqrt(m) nodes a block: the copies of a row that blocks of a group need then grow as sqrt(m) / 2.
    sized = groups.join(nodes.select("node", "size"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("shingles"))
    wide = F.least(F.lit(4096.0), F.greatest(F.lit(64.0), 2 * F.sqrt("m")))
    sized = sized.select("root", F.greatest(F.ceil(F.col("m") / wide), F.ceil(F.col("shingles") * 8 / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = groups.join(sized, "root").join(nodes.select("node", "first"), "node").select(
        "node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
        F.col("first.doc_id").alias("key_id"), F.col("first.th").alias("key_th"))
    texts = keyed.join(members, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("th") == F.col("key_th")))
    # A row that repeats as a whole brings its text as often: one is kept, by task before they meet.
    texts = texts.groupBy("node").agg(*[F.first(c).alias(c) for c in ("root", "blocks", "block", "text")])
    sets = texts.select("node", "root", "blocks", "block", "text").mapInArrow(
        _with_sets, "node binary, root binary, blocks int, block int, shingles binary")
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "shingles")
    found = materialize(
        dealt.groupBy("root", "i", "j").applyInArrow(_compare(threshold, tolerance), "node binary, links long, root binary"), "links")

    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    placed = nodes.select("node", "first", "n_copies").join(links, "node", "left").join(joined, "node", "left").select(
        "node", "first", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("class_node"))
    placed = materialize(placed, "placed")
    heads = placed.groupBy("class_node").agg(F.min("first").alias("head"))
    labelled = materialize(placed.drop("first").join(heads, "class_node"), "labelled")
    return signed.select("doc_id", "th", "node").join(labelled, "node").select(
        "doc_id", "th", "class_node", F.col("head.doc_id").alias("class_id"), "n_links", "n_copies",
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))).alias("keeper"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, all its columns; rows that repeat as a whole stay once."""
    kept = materialize(classify(docs, threshold).filter("keeper").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "kept")
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_th")))
    from pyspark.sql import Window

    once = Window.partitionBy("_id", "_th").orderBy("_th")
    return joined.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select(*docs.columns)
