"""Metrics, quantiles and quality reports against plain computation."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskflow import schemas as S
from riskflow.operators import evaluate, ordered, quality, quantiles
from riskflow.sources import files


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(f"t{i}", rng.randrange(40) / 40, rng.random() < 0.3) for i in range(500)]
    return spark.createDataFrame(rows, "transaction_id string, score double, is_fraud boolean"), rows


def curve(rows):
    total = sum(y for _, _, y in rows)
    out = []
    for t in sorted({s for _, s, _ in rows}):
        tp, n = sum(y for _, s, y in rows if s >= t), sum(s >= t for _, s, _ in rows)
        out.append((t, tp / n, tp / total))
    return out


@pytest.mark.parametrize("limit", [2_000_000, 5])
def test_curve_and_average_precision(scored, limit):
    df, rows = scored
    got = sorted((r.threshold, r.precision, r.recall) for r in evaluate.pr_curve(df, "score", "is_fraud", max_group_rows=limit).collect())
    want = curve(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in want])
    down = want[::-1]
    ap = sum((r - (down[i - 1][2] if i else 0)) * p for i, (_, p, r) in enumerate(down))
    assert evaluate.average_precision(df, "score", "is_fraud").first()[0] == pytest.approx(ap)


def test_fbeta_takes_lowest_of_equal_scores(spark):
    df = spark.createDataFrame([(0.9, True), (0.5, False), (0.4, False)], "score double, is_fraud boolean")
    assert evaluate.fbeta_threshold(df, "score", "is_fraud").first().threshold == 0.9
    tied = spark.createDataFrame([(0.2, False), (0.6, False)], "score double, is_fraud boolean")
    assert evaluate.fbeta_threshold(tied, "score", "is_fraud").first().threshold == 0.5


def test_report_of_nothing_predicted_is_zero(scored):
    r = evaluate.classification_report(scored[0], "score", "is_fraud", 2.0).first()
    assert (r.precision, r.recall, r.f1_score) == (0.0, 0.0, 0.0) and r.support == sum(y for _, _, y in scored[1])


def test_buckets_are_right_closed_and_all_listed(spark):
    df = spark.createDataFrame([(0.0, True), (100.0, False), (100.01, True), (None, True)], "amount double, is_fraud boolean")
    got = {r.bucket: (r.transactions, r.fraud_rate) for r in evaluate.bucket_rates(df, "amount", S.AMOUNT_EDGES, S.AMOUNT_LABELS).collect()}
    assert got == {"<=100": (2, 0.5), "100-1k": (1, 1.0), "1k-10k": (0, None), "10k-100k": (0, None), ">100k": (0, None)}


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
@pytest.mark.parametrize("small", [100_000, 20])
def test_exact_quantile(spark, monkeypatch, q, small):
    monkeypatch.setattr(quantiles, "SMALL_BRACKET", small)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(3, 2, 3000), np.full(2000, 7.0)])
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    assert quantiles.exact_quantile(df, "x", q) == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_quantiles_of_several_columns_at_once(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL_BRACKET", 50)
    df = spark.range(5000).selectExpr("double((id * 7919) % 1009) / 3 AS a", "if(id % 5 = 0, null, double(id % 4)) AS b", "-double(id) AS c", "double(null) AS d")
    frame = df.toPandas()
    got = quantiles.exact_quantiles(df, {"a": 0.3, "b": 0.5, "c": 0.99, "d": 0.5})
    assert got.pop("d") is None
    for c, q in {"a": 0.3, "b": 0.5, "c": 0.99}.items():
        assert got[c] == pytest.approx(float(frame[c].quantile(q)), rel=1e-12)


def test_quantile_of_one_repeated_value(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL_BRACKET", 10)
    assert quantiles.exact_quantile(spark.range(500).select(F.lit(4.0).alias("x")), "x", 0.9) == 4.0
    assert quantiles.exact_quantile(spark.range(5).select(F.lit(None).cast("double").alias("x")), "x", 0.9) is None


def test_quantiles_take_two_readings_and_know_ties_and_nan(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL_BRACKET", 1_000)
    monkeypatch.setattr(quantiles, "ACCURACY", 1_000)
    monkeypatch.setattr(quantiles, "_MARGIN", 4 / 1_000)
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(20_000).selectExpr(
        "double((id * 7919) % 20011) / 7 AS a", "if(id % 5 < 2, 3.0D, double(id % 1000)) AS b",
        "if(id % 10 = 0, double('NaN'), -double(id)) AS c", "if(id % 2 = 0, double('NaN'), double(id)) AS d",
        "if(id % 3 = 0, double('Infinity'), double('-Infinity')) AS e")
    frame = rows.toPandas()
    wanted = {"a": 0.9, "b": 0.25, "c": 0.37, "d": 0.75, "e": 0.99}
    got = quantiles.exact_quantiles(rows.mapInArrow(passed, rows.schema), wanted)  # pandas would make NaN null
    assert read.value == 2 * 20_000
    for c in "abc":
        values = np.sort(frame[c].to_numpy())  # NaN last
        place = wanted[c] * 19_999
        low, high = values[int(place)], values[int(np.ceil(place))]
        assert got[c] == pytest.approx(low + (high - low) * (place - int(place)), rel=1e-12)
    assert np.isnan(got["d"]) and got["e"] == np.inf


def test_many_values_in_a_bracket_are_summed_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MAX_GROUP_ROWS", 100)
    monkeypatch.setattr(ordered, "MAX_GROUP_ROWS", 100)
    df = spark.range(3_000).selectExpr("double((id * 7919) % 3001) AS a")
    assert quantiles.exact_quantile(df, "a", 0.5) == pytest.approx(float(np.quantile(df.toPandas()["a"], 0.5)), rel=1e-12)


def test_a_bracket_that_misses_its_rank_is_opened(spark, monkeypatch):
    rows = spark.range(100).selectExpr("double(id) AS x")
    monkeypatch.setattr(quantiles, "_sketched", lambda data, wanted: [quantiles._Bracket("x", 10.0, 20.0, 49.5)])
    assert quantiles.exact_quantile(rows, "x", 0.5) == 49.5
    monkeypatch.setattr(quantiles, "_sketched", lambda data, wanted: [quantiles._Bracket("x", 80.0, 90.0, 49.5)])
    assert quantiles.exact_quantile(rows, "x", 0.5) == 49.5


def test_overlap_equals_histogram_overlap(spark):
    rng = np.random.default_rng(2)
    y = rng.random(2000) < 0.4
    x = np.where(y, rng.normal(1, 1, 2000), rng.normal(0, 1, 2000))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "is_fraud": y}))
    bins = np.histogram_bin_edges(x, bins=50)
    f, _ = np.histogram(x[y], bins=bins, density=True)
    n, _ = np.histogram(x[~y], bins=bins, density=True)
    want = float(np.minimum(f, n).sum() * (bins[1] - bins[0]))
    assert quality.overlap(df, ["x"]).first().overlap == pytest.approx(want, abs=2e-3)
    empty = quality.overlap(df.filter("is_fraud"), ["x"]).first().overlap
    assert empty == 0.0


@pytest.mark.parametrize("limit", [2_000_000, 25])
def test_auc_with_ties(spark, limit):
    rng = np.random.default_rng(4)
    y = rng.random(600) < 0.3
    x = np.round(rng.normal(y.astype(float), 1.0), 1)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "is_fraud": y}))
    pos, neg = x[y], x[~y]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert quality.single_feature_auc(df, ["x"], max_group_rows=limit).first().auc == pytest.approx(max(auc, 1 - auc), abs=1e-4)
    assert quality.single_feature_auc(df.limit(99), ["x"]).first().auc == 0.5


def test_clips_and_faults(spark):
    df = spark.createDataFrame([("a", -5.0, 1.4), ("b", None, -0.1)], "transaction_id string, amount double, ip_risk_score double")
    assert [tuple(r)[1:] for r in quality.clip_ranges(df).collect()] == [(0.0, 1.0), (None, 0.0)]
    many = spark.range(20_000).select(F.col("id").cast("string").alias("transaction_id"), F.lit(10.0).alias("amount"))
    a, b = quality.inject_faults(many), quality.inject_faults(many)
    assert a.exceptAll(b).count() == 0
    assert 0.005 < a.filter("amount IS NULL").count() / 20_000 < 0.015


def test_training_csv_round_trip_and_missing_file(spark, tmp_path):
    row = {n: 1.0 for n in S.BASE_FEATURES} | {"is_device_trusted": True, "has_country_mismatch": False, "merchant_category": "TRAVEL", "card_type": "DEBIT"}
    df = spark.createDataFrame([("t", "u", *[row[n] for n in S.BASE_FEATURES], True)], S.TRAINING_SCHEMA)
    files.write_training_csv(df, str(tmp_path / "csv"))
    assert files.read_training_csv(spark, str(tmp_path / "csv")).collect() == df.collect()
    with pytest.raises(files.TrainingDataError):
        files.read_training_csv(spark, str(tmp_path / "absent"))


def test_features_without_values_are_listed(spark):
    from riskflow.operators import quality

    rows = [(float(i), None, float("nan") if i == 7 else float(i % 5), i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, is_fraud boolean")
    aucs = {r.feature: r.auc for r in quality.single_feature_auc(df, ["a", "b", "c"]).collect()}
    assert set(aucs) == {"a", "b", "c"} and aucs["b"] == 0.5
    assert {r.feature: r.overlap for r in quality.overlap(df, ["a", "b", "c"]).collect()}["b"] == 0.0
    assert {r.feature: r.overlap for r in quality.categorical_overlap(df, ["b", "c"]).collect()}["b"] == 0.0
    clean = {r.feature: r.auc for r in quality.single_feature_auc(df.filter("NOT isnan(c)"), ["c"]).collect()}
    assert aucs["c"] == clean["c"]


def test_distinct_values_are_written_once_and_hold_no_names(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(quality, "written", lambda df, name: kept.append(df) or ordered.written(df, name))
    rows = [(float(i % 50), float(i), i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, is_fraud boolean")
    for limit in (2_000_000, 100):
        found = quality.single_feature_auc(df, ["a", "b"], max_group_rows=limit)
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {r.feature for r in found.collect()} == {"a", "b"}
    assert len(kept) == 2 and "string" not in dict(kept[0].dtypes).values()
