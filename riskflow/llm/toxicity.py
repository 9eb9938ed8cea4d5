"""Convolutional text classifier: hashed word embeddings, several filter widths, max pooling, in numpy.

Thresholds are calibrated for each language on a part of the labelled rows that no step trains on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskflow.llm.common import IN_WORD, LOWER, SpanHasher, held_out, materialize, text_blocks, word_spans
from riskflow.llm.quality import in_order, labelled_sample, learnable
from riskflow.operators.ordered import Agg, running

#: Bound of the labelled rows that a fit takes.
MAX_LABELLED = 8000
BUCKET_BITS = 15
DIMENSION = 16
FILTERS = 12
WIDTHS = (1, 2, 3)
#: A word's vector is the sum of the vectors of the whole word and of its first so many bytes.
PREFIXES = (4, 5, 6)
EPOCHS = 6
RATE = 0.05
BATCH = 32
#: Small samples are gone through more often, until so many batches were seen.
LEAST_STEPS = 600
#: Language thresholds need so many calibration rows of either label; other languages take the common one.
LEAST_ROWS = 20
#: A text of more bytes is gone through in pieces of about this size.
PIECE_BYTES = 1 << 20
_PIECES = 1 + len(PREFIXES)
_PAD = 1 << BUCKET_BITS


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the pieces of every word, offsets of each text's words): [words, 1 + prefixes]."""
    data = LOWER[data]
    start, end, at = word_spans(data, offsets)
    hasher = SpanHasher(data)
    shift = np.uint64(64 - BUCKET_BITS)
    ids = [hasher(start, end) >> shift] + [hasher(start, np.minimum(end, start + k), k) >> shift for k in PREFIXES]
    return np.stack(ids, axis=1).astype(np.int32), at


def word_pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """The word_rows ids of one text a piece at a time. Pieces end between words; a word is never cut, however long."""
    a = 0
    while a < len(data):
        b = min(len(data), a + PIECE_BYTES)
        while b < len(data):
            inside = IN_WORD[LOWER[data[b:b + PIECE_BYTES]]]
            gap = int(inside.argmin())
            if not inside[gap]:
                b += gap
                break
            b += len(inside)
        yield word_rows(data[a:b], np.array([0, b - a]))[0]
        a = b


def _padded(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all texts with empty rows after each: (ids, first row of each text, whether a window may start)."""
    pad = max(WIDTHS)
    n = len(at) - 1
    first = at[:-1] + pad * np.arange(n)
    out = np.full((len(ids) + pad * n, _PIECES), _PAD, np.int32)
    ok = np.zeros(len(out), bool)
    place = np.arange(len(ids)) + pad * np.repeat(np.arange(n), np.diff(at))
    out[place] = ids
    ok[place] = True
    ok[first] = True  # a text without words is one window of empty rows
    return out, first, ok


@dataclass
class ToxicityModel:
    vectors: np.ndarray  # [buckets + 1, D], the last row stays zero
    filters: dict[int, np.ndarray]  # by width: [width, D, F]
    shift: dict[int, np.ndarray]
    output: np.ndarray
    bias: float
    thresholds: dict[str | None, float] = field(default_factory=lambda: {None: 0.5})

    def pooled(self, ids: np.ndarray, at: np.ndarray, starts: int | None = None):
        """Largest answer of every filter in each text, with the rows and windows behind it; of one text, only
        windows among the first `starts` words may be asked for."""
        rows, first, ok = _padded(ids, at)
        if starts is not None:
            ok[starts:] = False
        x = self.vectors[rows].sum(axis=1)
        tops, windows = [], {}
        for w in WIDTHS:
            z = x @ self.filters[w][0]
            for o in range(1, w):
                z[:-o] += x[o:] @ self.filters[w][o]
            z[~ok] = -np.inf
            windows[w] = z
            tops.append(np.maximum.reduceat(z, first, axis=0) + self.shift[w])
        return np.concatenate(tops, axis=1), x, rows, first, windows

    def probability(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        return self._answer(self.pooled(ids, at)[0])

    def probability_of_pieces(self, pieces: Iterator[np.ndarray]) -> np.ndarray:
        """The probability of one text whose words come in pieces: the last words of a piece lead into the next, so
        every window is seen once and no more than a piece is held."""
        lead = max(WIDTHS) - 1
        last, top = np.zeros((0, _PIECES), np.int32), np.full((1, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for ids in pieces:
            last = np.concatenate([last, ids])
            if len(last) > lead:
                starts = len(last) - lead
                top = np.maximum(top, self.pooled(last, np.array([0, len(last)]), starts)[0])
                last = last[starts:]
        return self._answer(np.maximum(top, self.pooled(last, np.array([0, len(last)]))[0]))

    def _answer(self, top: np.ndarray) -> np.ndarray:
        top = np.maximum(top, 0).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(top @ self.output.astype(np.float64) + self.bias, -50, 50)))

    def threshold(self, lang: Column) -> Column:
        out = F.lit(self.thresholds[None])
        for name, value in self.thresholds.items():
            if name is not None:
                out = F.when(lang == name, value).otherwise(out)
        return out


class _Adagrad:
    def __init__(self, shape, rate):
        self.sum, self.rate = np.full(shape, 1e-6, np.float32), rate

    def step(self, at, grad):
        self.sum[at] += grad * grad
        return self.rate * grad / np.sqrt(self.sum[at])


def _joined(words, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each = [words(i) for i in batch]
    return np.concatenate(each), np.concatenate([[0], np.cumsum([len(w) for w in each])])


def _train(model: ToxicityModel, words, docs: np.ndarray, y: np.ndarray, epochs: int, rate: float, rng) -> None:
    mean = y[docs].mean()
    weight = np.where(y == 1, 0.5 / max(1e-9, mean), 0.5 / max(1e-9, 1 - mean)) ** 0.5
    grads = {"v": _Adagrad(model.vectors.shape, rate), "o": _Adagrad(model.output.shape, rate), "b": _Adagrad((1,), rate)}
    grads |= {w: _Adagrad(model.filters[w].shape, rate) for w in WIDTHS} | {-w: _Adagrad(model.shift[w].shape, rate) for w in WIDTHS}
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // len(docs)))):
        order = rng.permutation(docs)
        for k in range(0, len(order), BATCH):
            batch = order[k:k + BATCH]
            top, x, rows, first, windows = model.pooled(*_joined(words, batch))
            active = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ model.output + model.bias, -30, 30)))
            d = ((p - y[batch]) * weight[batch]).astype(np.float32)
            back = d[:, None] * model.output[None, :] * (top > 0)
            dx = {}
            stop = np.append(first[1:], len(x))
            for j, w in enumerate(WIDTHS):
                z, part = windows[w], back[:, j * FILTERS:(j + 1) * FILTERS]
                best = np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(first, stop)])  # [texts, F]
                g = np.zeros_like(model.filters[w])
                for o in range(w):
                    g[o] = np.einsum("nfd,nf->df", x[best + o], part)
                    dx.setdefault("row", []).append((best + o).ravel())
                    dx.setdefault("grad", []).append((part[:, :, None] * model.filters[w][o].T[None]).reshape(-1, DIMENSION))
                model.filters[w] -= grads[w].step(..., g)
                model.shift[w] -= grads[-w].step(..., part.sum(axis=0))
            row, grad = np.concatenate(dx["row"]), np.concatenate(dx["grad"])
            live = np.abs(grad).sum(axis=1) > 0
            ids = rows[row[live]].ravel()
            found, inverse = np.unique(ids, return_inverse=True)
            summed = np.zeros((len(found), DIMENSION), np.float32)
            np.add.at(summed, inverse, np.repeat(grad[live], _PIECES, axis=0))
            summed[found == _PAD] = 0
            model.vectors[found] -= grads["v"].step(found, summed)
            model.output -= grads["o"].step(..., active.T @ d)
            model.bias -= float(grads["b"].step(0, d.sum()))


def _not_trained_on(docs: DataFrame, labels: DataFrame, label: str, trained: np.ndarray, model: ToxicityModel) -> DataFrame:
    """(lang, label, score) of every labelled row that isn't held out and that no step trains on, one row an id.

    Rows are scored where they lie and only scores meet the labels, so no text moves. Of rows that repeat an id the one
    with the smallest hash of its text counts, as in the sample.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text.alias("text"), F.xxhash64(text).alias("hash"))
    scored = score(rows.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), model, ("doc_id", "lang", "hash"))
    used = docs.sparkSession.createDataFrame([(int(i),) for i in trained], "doc_id long")  # bounded as the training rows are
    known = learnable(labels, label).join(F.broadcast(used), "doc_id", "left_anti")
    one = F.min(F.struct("hash", "lang", "score")).alias("_row")
    return scored.join(known, "doc_id").groupBy("doc_id", "label").agg(one).select(
        "_row.lang", F.least(F.greatest("label", F.lit(0)), F.lit(1)).alias("label"), "_row.score")


def _thresholds(scored: DataFrame) -> dict[str | None, float]:
    """The score of best F1 by language and of all rows (None), midway to the next lower score, kept within 0.1 and 0.9."""
    both = F.array(F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("name")),
                   F.struct(F.lit(False).alias("every"), F.col("lang").alias("name")))
    counts = (
        scored.select(F.explode(both).alias("of"), "label", "score").select("of.*", "label", "score").filter("every OR name IS NOT NULL")
        .groupBy("every", F.coalesce("name", F.lit("")).alias("name"), "score").agg(F.sum("label").cast("long").alias("hits"), F.count("*").alias("n")))
    counts = materialize(counts.withColumn("down", -F.col("score")), "threshold-scores")
    sums = counts.groupBy("every", "name").agg(F.sum("hits").alias("marked"), F.sum("n").alias("rows"))
    enough = F.when(F.col("every"), F.col("marked") > 0).otherwise(F.least("marked", F.col("rows") - F.col("marked")) >= LEAST_ROWS)
    above = running(counts, ["every", "name"], ["down"], {"_hits": Agg("sum", F.col("hits")), "_n": Agg("sum", F.col("n"))})
    hits, taken = F.coalesce("_hits", F.lit(0)) + F.col("hits"), F.coalesce("_n", F.lit(0)) + F.col("n")
    f1 = 2 * hits / (taken + F.greatest(F.lit(1), F.col("marked")))
    best = above.join(F.broadcast(sums.filter(enough)), ["every", "name"]).groupBy("every", "name").agg(
        F.max_by("score", F.struct(f1, F.col("score"))).alias("best"))
    found = counts.join(F.broadcast(best), ["every", "name"]).groupBy("every", "name", "best").agg(
        F.max(F.when(F.col("score") < F.col("best"), F.col("score"))).alias("below")).collect()  # a row a language
    return {None if r["every"] else r["name"]: float(np.clip((r["best"] + (r["below"] or 0.0)) / 2, 0.1, 0.9)) for r in found}


def _to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches):
        ids, at = word_rows(data, offsets)  # the sample has no very long text
        packed = [ids[a:b].astype(np.uint16).tobytes() for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(packed, pa.binary())], ["doc_id", "label", "lang", "ids"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED,
        epochs: int = EPOCHS, rate: float = RATE, seed: int = 2) -> ToxicityModel:
    """Trains on at most about max_labelled labelled rows less a fifth; thresholds come from all others that have a label.

    The language only chooses a threshold; it is no input of a score. Without labelled rows every score is 0.5.
    """
    sample = labelled_sample(docs, labels, label, max_labelled)
    rows = sample.select("doc_id", "label", "lang", "text").mapInArrow(_to_words, "doc_id long, label int, lang string, ids binary").toArrow()
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.3, (_PAD + 1, DIMENSION)).astype(np.float32)
    vectors[_PAD] = 0
    model = ToxicityModel(
        vectors, {w: rng.normal(0, 0.4 / w, (w, DIMENSION, FILTERS)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    if not len(rows):
        return model
    y, cells = in_order(rows, "ids")
    y = y.astype(np.float32)
    words = lambda i: cells(i).view(np.uint16).reshape(-1, _PIECES).astype(np.int32)
    kept = rng.random(len(y)) < 0.2
    train = np.flatnonzero(~kept)
    if len(train):
        _train(model, words, train, y, epochs, rate, rng)
    ids = np.sort(rows.column("doc_id").to_numpy())[train]
    model.thresholds |= _thresholds(_not_trained_on(docs, labels, label, ids, model))
    return model


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and score (probability of label 1) of every whole text, one row a row.

    A null text counts as empty; a text without words gets the score of empty windows. Only the named
    columns and text are read. Equal texts get equal scores. A very long text is gone through in pieces.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 MB
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for rows, data, offsets in text_blocks(batches, "_whole_text", 1 << 19):
            long = len(rows) == 1 and len(data) > PIECE_BYTES
            out = net.probability_of_pieces(word_pieces(data)) if long else net.probability(*word_rows(data, offsets))
            yield pa.RecordBatch.from_arrays([*rows.columns[:len(keep)], pa.array(out, pa.float64())], [*keep, "score"])

    return docs.select(*keep, F.col("text").alias("_whole_text")).mapInArrow(scored, schema)


def judged(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, lang, score, threshold of the language, toxic (score at or above it, so ties are toxic)."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text"), model, ("doc_id", "lang"))
    return out.withColumn("threshold", model.threshold(F.col("lang"))).withColumn("toxic", F.col("score") >= F.col("threshold"))
