"""The classifiers' features and scores against plain Python, one word and one window at a time."""

import math

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskflow.llm import bpe, quality, toxicity

TEXTS = ["", "one", "Two words", "a b a b b  longer\ttokens, here\n", "Grüße an Ünïcode x1y2 -- 99 bottles of the very same beer " * 3, "....", None]


def test_quality_features_and_scores_are_the_plain_ones(spark):
    rng = np.random.default_rng(1)
    model = quality.QualityModel(rng.normal(size=(quality.SIZE, quality.DIMENSION)).astype(np.float32),
                                 rng.normal(size=(quality.DIMENSION, 2)).astype(np.float32), np.array([0.2, -0.1], np.float32))
    odd, top = [int(x) for x in quality._ODD], 1 << 32

    def bucket(h, seed):
        return int(quality._bucket(np.array([h % top], np.uint32), seed)[0])

    def plain(text):
        tokens, ids = text.split(), []
        for t in tokens:
            ids.append((1 << quality.BUCKET_BITS) + bucket(sum(ord(c) * odd[6] * pow(odd[7], i, top) for i, c in enumerate(t)), 1))
            edged = f" {t} "
            for n in quality.GRAMS:
                ids += [bucket(sum(ord(c) * odd[k] for k, c in enumerate(edged[i:i + n])), n - 1) for i in range(len(edged) - n + 1)]
        ids += [quality._SAME if a == b else quality._OTHER for a, b in zip(tokens, tokens[1:])]
        hidden = model.vectors[ids].mean(axis=0) if ids else np.zeros(quality.DIMENSION)
        z = hidden @ model.output + model.bias
        return sorted(ids), 1 / (1 + math.exp(z[0] - z[1]))

    texts = [t or "" for t in TEXTS]
    (_, _, ids, owner), = quality.feature_blocks(texts)
    assert [sorted(ids[owner == i].tolist()) for i in range(len(texts))] == [plain(t)[0] for t in texts]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert got == pytest.approx({i: plain(t)[1] for i, t in enumerate(texts)}, abs=1e-4)


def network(seed: int = 2) -> toxicity.ToxicityModel:
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(toxicity._PAD + 1, toxicity.DIMENSION)).astype(np.float32)
    vectors[toxicity._PAD] = 0
    return toxicity.ToxicityModel(
        vectors, {w: rng.normal(size=(w, toxicity.DIMENSION, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS},
        {w: rng.normal(size=toxicity.FILTERS).astype(np.float32) for w in toxicity.WIDTHS},
        rng.normal(0, 0.1, toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32), 0.1)


def plain_score(net: toxicity.ToxicityModel, text: str) -> float:
    """Every word hashed alone, every window multiplied alone; windows may run over the end into empty rows."""
    import re

    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    def vector(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return net.vectors[toxicity.word_rows(data, np.array([0, len(data)]))[0][0]].sum(axis=0)

    rows = [vector(w) for w in words] + [np.zeros(toxicity.DIMENSION)] * max(toxicity.WIDTHS)
    tops = []
    for w in toxicity.WIDTHS:
        answers = [sum(rows[i + o] @ net.filters[w][o] for o in range(w)) for i in range(max(1, len(words)))]
        tops.append(np.max(answers, axis=0) + net.shift[w])
    z = np.maximum(np.concatenate(tops), 0) @ net.output + net.bias
    return 1 / (1 + math.exp(-z))


def test_toxicity_scores_are_the_plain_ones(spark):
    net = network()
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    assert got == pytest.approx({i: plain_score(net, t or "") for i, t in enumerate(TEXTS)}, abs=1e-4)


@pytest.mark.parametrize("text", ["", "word", "two words", "a bb ccc dddd eeeee ffffff " * 40, "x" * 500 + " y " + "é" * 300, " . " * 90 + "end"])
def test_pieces_of_a_long_text_score_as_the_whole(monkeypatch, text):
    net, data = network(), np.frombuffer(text.encode(), np.uint8)
    ids, at = toxicity.word_rows(data, np.array([0, len(data)]))
    for size in (1, 7, 64):
        monkeypatch.setattr(toxicity, "PIECE_BYTES", size)
        pieces = list(toxicity.word_pieces(data))
        assert np.array_equal(np.concatenate([*pieces, ids[:0]]), ids)
        assert net.probability_of_pieces(iter(pieces)) == pytest.approx(net.probability(ids, at), abs=1e-5)


def test_a_text_of_tens_of_megabytes_is_scored_whole(spark):
    net = network()
    docs = spark.range(1).selectExpr("id AS doc_id", "concat(repeat('some plain words here. ', 1000000), 'last words') AS text")
    short = spark.createDataFrame([(1, "some plain words here. " * 3 + "last words")], "doc_id long, text string")
    assert toxicity.score(docs, net).first().score == pytest.approx(toxicity.score(short, net).first().score, abs=1e-5)


def test_the_sample_is_bounded_in_bytes(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "if(id % 100 = 7, repeat('long ', 200), repeat('w', 50)) AS text")
    marks = docs.selectExpr("doc_id", "1 AS quality")
    rows = quality.labelled_sample(docs, marks, "quality", 10_000, 200 * quality.MOST_OF_BYTES).collect()
    assert all(len(r.text) == 50 for r in rows) and len(rows) > 1300  # all short ones fit
    fewer = quality.labelled_sample(docs, marks, "quality", 10_000, 50 * quality.MOST_OF_BYTES).collect()
    assert len(fewer) == quality.MOST_OF_BYTES


def test_long_pieces_are_encoded_but_not_remembered():
    own, library = bpe.Codec(bpe.vocabulary()), Tokenizer.from_str(bpe.vocabulary().decode())
    for text in ("ab" * 3000, "é" * 500 + " short", "9" * 65):
        for _ in range(2):
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, own.memory)) <= bpe.REMEMBERED_CHARS


def test_thresholds_come_from_all_labelled_rows_that_no_step_trains_on(spark):
    from pyspark.sql import functions as F

    from riskflow.llm.common import held_out

    rows = [(i, f"good words {i % 7}" if i % 3 else f"vile scum {i % 5}", "en", int(i % 3 == 0)) for i in range(900)]
    every = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    docs, labels = every.drop("toxic"), every.select("doc_id", "toxic")
    seen, found = [], toxicity._thresholds
    try:
        toxicity._thresholds = lambda scored: seen.append(scored.count()) or found(scored)
        model = toxicity.fit(docs, labels, max_labelled=200)
    finally:
        toxicity._thresholds = found
    learnt_from = every.filter(~held_out(F.col("doc_id"))).count()
    assert seen[0] >= learnt_from - 200 - 60 and set(model.thresholds) == {None, "en"}
    # As stated on the whole: the highest score of best F1, midway to the next lower one.
    scores = [(0.9, 1), (0.8, 0), (0.8, 1), (0.6, 1), (0.4, 0), (0.3, 0)] * 30
    got = toxicity._thresholds(spark.createDataFrame([("en", y, s) for s, y in scores], "lang string, label int, score double"))
    assert got == {None: 0.5, "en": 0.5}
