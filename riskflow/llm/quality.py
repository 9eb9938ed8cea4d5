"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from riskflow.llm.common import held_out, materialize

#: Bounds of the labelled rows that a fit takes: how many, and the bytes of their texts together. A text of more than
#: MAX_BYTES / MOST_OF_BYTES isn't learnt from.
MAX_LABELLED = 6000
MAX_BYTES, MOST_OF_BYTES = 1 << 26, 512
BUCKET_BITS = 16
GRAMS = (3, 4, 5)
#: Features of a pair of neighbouring tokens: equal or not. Hashes of the tokens can't tell that.
_SAME, _OTHER = 2 << BUCKET_BITS, (2 << BUCKET_BITS) + 1
SIZE = (2 << BUCKET_BITS) + 2
DIMENSION = 16
EPOCHS = 4
RATE = 0.5
_BLOCK_CHARS = 1 << 19
_ODD = np.random.default_rng(11).integers(1, 2**31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SPACES = [9, 10, 11, 12, 13, 32, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_IS_SPACE = np.zeros(0x3002, bool)
_IS_SPACE[_SPACES] = True


def _bucket(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * seed)
    h ^= h >> np.uint32(13)
    h = h * np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - BUCKET_BITS)


def feature_blocks(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, feature ids, text of each id) for blocks of whole texts.

    A token is a run without white space, in its own case. Its features are the hash of the token and
    of every 3 to 5 code points of it with a space before and after; a pair of neighbours adds whether they are equal.
    """
    a = 0
    while a < len(texts):
        b, chars = a, 0
        while b < len(texts) and (b == a or chars + len(texts[b]) < _BLOCK_CHARS):
            chars += len(texts[b]) + 2
            b += 1
        flat = np.frombuffer((" " + " \n ".join(texts[a:b]) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        # A line feed between texts marks where one ends; inside a text it is white space like any other.
        lengths = np.array([len(t) for t in texts[a:b]], np.int64)
        space = _IS_SPACE[np.minimum(flat, 0x3001)]
        codes = np.where(space, np.uint32(32), flat)
        owner = np.concatenate([np.zeros(1, np.int32), np.repeat(np.arange(b - a, dtype=np.int32), lengths + 3)])[:len(flat)]
        ids, texts_of = [], []
        begins = np.flatnonzero(~space[1:] & space[:-1]) + 1
        ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        powers = np.cumprod(np.full(len(flat), _ODD[7], np.uint32), dtype=np.uint32)
        inverse = np.cumprod(np.full(len(flat), pow(int(_ODD[7]), -1, 1 << 32), np.uint32), dtype=np.uint32)
        sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum((codes * _ODD[6]) * powers, dtype=np.uint32)])
        word = (sums[ends] - sums[begins]) * inverse[begins]
        ids.append(_bucket(word, 1) + np.uint32(1 << BUCKET_BITS))
        texts_of.append(owner[begins])
        near = owner[begins][1:] == owner[begins][:-1]
        ids.append(np.where(word[1:] == word[:-1], np.uint32(_SAME), np.uint32(_OTHER))[near])
        texts_of.append(owner[begins][1:][near])
        gaps = np.concatenate([[0], np.cumsum(space)])
        rolling = np.zeros(len(flat), np.uint32)
        for k in range(max(GRAMS)):
            n = len(flat) - k
            rolling = rolling[:n] + codes[k:] * _ODD[k]
            if k + 1 in GRAMS and n > 0:
                valid = np.flatnonzero(gaps[k:k + n] == gaps[1:n + 1])  # white space at the ends only
                ids.append(_bucket(rolling[valid], k))
                texts_of.append(owner[valid + 1])
        yield a, b, np.concatenate(ids), np.concatenate(texts_of)
        a = b


def counted_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct feature ids and their counts of every text: at most SIZE each."""
    for batch in batches:
        d = batch.to_pydict()
        texts = [t or "" for t in d["text"]]
        for a, b, ids, owner in feature_blocks(texts):
            order = np.argsort(owner, kind="stable")
            ids, cuts = ids[order], np.searchsorted(owner[order], np.arange(b - a + 1))
            found = [np.unique(ids[x:y], return_counts=True) for x, y in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(d["doc_id"][a:b], pa.int64()), "label": pa.array(d["label"][a:b], pa.int32()),
                "ids": pa.array([x.astype(np.int32).tobytes() for x, _ in found], pa.binary()),
                "counts": pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())})


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of every labelled id that may be learnt from, one row an id; held-out ones never."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, text, lang, label): about `most` labelled rows at most, by a hash of the id; held-out rows never.

    Of the rows that repeat a sampled id the one with the smallest hash of its text stays. Texts of more than
    max_bytes / MOST_OF_BYTES bytes are left out; of the others come as many as max_bytes holds, in the order of a hash.
    """
    known = learnable(labels, label)
    share = min(1.0, most / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 62)) < int(share * (1 << 62)))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    # The sample is bounded by `most`, so its ids may be sent to every task.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang")).join(
        F.broadcast(known), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("_hash"), "text", "lang")).alias("_row")
    sample = materialize(rows.groupBy("doc_id", "label").agg(one).select("doc_id", "_row.text", "_row.lang", "label"), "labelled")
    sized = sample.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).filter(F.col("bytes") <= max_bytes // MOST_OF_BYTES)
    # About `most` ids and sizes: one task orders them.
    upto = F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id"))
    taken = sized.withColumn("_upto", upto).filter(F.col("_upto") <= max_bytes).select("doc_id")
    return sample.join(F.broadcast(taken), "doc_id", "left_semi").select("doc_id", "text", "lang", "label")


def in_order(rows: pa.Table, *columns: str):
    """(labels, a function for each binary column that gives row i's bytes as a view), rows in the order of doc_id."""
    order = pa.compute.sort_indices(rows, [("doc_id", "ascending")]).to_numpy()

    def views(name: str):
        cells = rows.column(name)
        starts = np.cumsum([0, *[len(c) for c in cells.chunks]])

        def at(i: int) -> np.ndarray:
            k = int(np.searchsorted(starts, order[i], "right")) - 1
            cell = cells.chunk(k)[int(order[i] - starts[k])].as_buffer()
            return np.frombuffer(cell, np.uint8) if cell.size else np.zeros(0, np.uint8)

        return at

    return rows.column("label").to_numpy().astype(np.int64)[order].clip(0, 1), *map(views, columns)


@dataclass
class QualityModel:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """The averaged vectors meet the output layer linearly: one number for each bucket says the same."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED,
        epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> QualityModel:
    """Trains on at most about max_labelled labelled rows; without any, every score is 0.5."""
    rows = labelled_sample(docs, labels, label, max_labelled).select("doc_id", "label", "text").mapInArrow(
        counted_features, "doc_id long, label int, ids binary, counts binary").toArrow()
    y, ids, counts = in_order(rows, "ids", "counts")
    rng = np.random.default_rng(seed)
    model = QualityModel(rng.uniform(-1, 1, (SIZE, DIMENSION)).astype(np.float32) / DIMENSION, np.zeros((DIMENSION, 2), np.float32), np.zeros(2, np.float32))
    if not len(y):
        return model
    prior = (np.bincount(y, minlength=2) + 1) / (len(y) + 2)
    model.bias[:] = np.log(prior)
    steps = epochs * len(y)
    for step in range(steps):
        if step % len(y) == 0:
            order = rng.permutation(len(y))
        i = order[step % len(y)]
        lr = rate * (1 - step / steps)
        at, n = ids(i).view(np.int32), counts(i).view(np.int32).astype(np.float32)
        weight = n / max(1.0, float(n.sum()))
        hidden = weight @ model.vectors[at]
        z = hidden @ model.output + model.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y[i]] -= 1
        back = model.output @ p
        model.output -= lr * np.outer(hidden, p)
        model.bias -= 0.1 * lr * p
        model.vectors[at] -= (lr * 4) * weight[:, None] * back
    return model


def score(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and score (probability of label 1) of every whole text, one row a row.

    A null text counts as empty; an empty text gets the score of the bias alone. Only the named columns
    and text are read, so others may bear any name. Equal texts get equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.folded())  # fixed size: SIZE numbers
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            out = np.empty(len(texts))
            for a, b, ids, owner in feature_blocks(texts):
                total = np.bincount(owner, table[ids], b - a)
                z = bias + total / np.maximum(1, np.bincount(owner, minlength=b - a))
                out[a:b] = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(out)], [*keep, "score"])

    return docs.select(*keep, F.col("text").alias("_whole_text")).mapInArrow(scored, schema)
