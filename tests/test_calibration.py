"""The isotonic fit against the plain formula: the largest of the least means."""

import numpy as np
import pandas as pd
import pytest

from riskflow.ml import calibration


def plain(frame: pd.DataFrame) -> dict[float, float]:
    points = frame.groupby("raw_probability")["is_fraud"].agg(["sum", "count"])
    y, n = points["sum"].to_numpy(float), points["count"].to_numpy(float)
    ys, ns = np.concatenate([[0], y.cumsum()]), np.concatenate([[0], n.cumsum()])
    out = {}
    for i, s in enumerate(points.index):
        out[s] = max(min((ys[k] - ys[j]) / (ns[k] - ns[j]) for k in range(i + 1, len(ys))) for j in range(i + 1))
    return out


def scored(spark, seed: int, n: int = 900, distinct: int = 200):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, distinct, n) / distinct
    return spark.createDataFrame(pd.DataFrame({"raw_probability": s, "is_fraud": rng.random(n) < s ** 2}))


@pytest.mark.parametrize("range_points", [1_000_000, 40, 3])
def test_fit_equals_the_plain_one_however_it_is_cut(spark, range_points):
    df = scored(spark, 5)
    frame = df.toPandas()
    model = calibration.fit_isotonic(df, range_points=range_points)
    want = plain(frame)
    got = {r.raw_probability: r.fraud_probability for r in model.transform(df).select("raw_probability", "fraud_probability").distinct().collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_blocks_of_ranges_are_those_of_the_whole(spark):
    df = scored(spark, 6, n=3000, distinct=700)
    blocks = [sorted(map(tuple, calibration.pooled_blocks(df, "raw_probability", "is_fraud", n).collect())) for n in (10_000, 9)]
    assert blocks[0] == blocks[1] and len(blocks[0]) < 100
    means = [t / w for _, _, t, w in blocks[0]]
    assert means == sorted(set(means)) and sum(w for *_, w in blocks[0]) == 3000


def test_falling_scores_are_one_block(spark):
    df = spark.range(50).selectExpr("double(id) AS raw_probability", "id < 20 AS is_fraud")
    assert [tuple(r) for r in calibration.pooled_blocks(df, "raw_probability", "is_fraud", 7).collect()] == [(0.0, 49.0, 20.0, 50.0)]


def test_rows_without_score_or_label_and_empty_tables(spark):
    df = spark.createDataFrame(
        [(0.1, False), (None, True), (float("nan"), True), (0.9, None), (0.9, True)], "raw_probability double, is_fraud boolean")
    got = sorted(map(tuple, calibration.pooled_blocks(df, "raw_probability", "is_fraud").collect()))
    assert got == [(0.1, 0.1, 0.0, 1.0), (0.9, 0.9, 1.0, 1.0)]
    assert calibration.pooled_blocks(df.limit(0), "raw_probability", "is_fraud").count() == 0
