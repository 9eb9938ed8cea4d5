"""Training: split, search, boosted trees with early stopping, calibration, threshold, metrics.

The search tunes on the validation part, the threshold comes from the calibration part and the
reported metrics from the test part, so no part is judged by what it helped to choose.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from riskflow import schemas as S
from riskflow.functions.scalar import at_most, encode_card_type, encode_category, hashed_uniform, risk_level
from riskflow.ml import boosting
from riskflow.ml.calibration import fit_isotonic
from riskflow.operators import evaluate
from riskflow.operators.ordered import written
from riskflow.operators.quantiles import fit_caps
from riskflow.operators.validate import check_contract
from riskflow.plans.feature_vector import engineer_features
from riskflow.session import shared_dir

# --- fixed values: search ranges (low, high, log scale) and defaults ---------------------------
SEARCH_RANGES = {
    "max_depth": (4, 10, False),
    "num_leaves": (15, 127, False),
    "learning_rate": (0.01, 0.2, True),
    "min_child_samples": (10, 200, False),
    "subsample": (0.5, 1.0, False),
    "colsample_bytree": (0.4, 1.0, False),
    "reg_alpha": (1e-3, 10.0, True),
    "reg_lambda": (1e-3, 10.0, True),
}
DEFAULT_PARAMS = {"max_depth": 10, "num_leaves": 108, "learning_rate": 0.1607, "min_child_samples": 135, "subsample": 0.556,
                  "colsample_bytree": 0.535, "reg_alpha": 1.677, "reg_lambda": 9.293}
SEARCH_ROUNDS, SEARCH_PATIENCE = 100, 50
WHOLE = ("max_depth", "num_leaves", "min_child_samples")
NOMINAL = {"merchant_category", "card_type"}


def model_inputs(df: DataFrame, names: list[str], caps: dict[str, float] | None = None) -> DataFrame:
    """Adds the model's numeric inputs as x_<name>, capped; the named columns keep their values."""
    caps = caps or {}
    return df.withColumns({f"x_{n}": at_most(F.col(n).cast("double"), caps.get(n)) for n in names})


def encoded(df: DataFrame) -> DataFrame:
    """Category names become their codes; codes stay."""
    columns = {"merchant_category": encode_category, "card_type": encode_card_type}
    return df.withColumns({
        c: fn(F.col(c)) for c, fn in columns.items() if c in df.columns and df.schema[c].dataType.typeName() == "string"})


def with_split(df: DataFrame, seed: int = 42, label: str = "is_fraud") -> DataFrame:
    """Adds `part`: train 70 %, calibration 15 %, test 15 % of each class, by a hash of id and
    seed: repeatable, no shuffle. A slice of the training part is marked for early stopping."""
    u = hashed_uniform(seed, F.col("transaction_id"), F.col(label).cast("string"))
    part = F.when(u < 0.595, "train").when(u < 0.70, "validation").when(u < 0.85, "calibration").otherwise("test")
    return df.withColumn("part", part)


def trial_params(n_trials: int, seed: int = 42) -> list[dict[str, float]]:
    """Random points of the search ranges."""
    rng = random.Random(seed)
    trials = []
    for _ in range(n_trials):
        point = {}
        for name, (low, high, log) in SEARCH_RANGES.items():
            value = math.exp(rng.uniform(math.log(low), math.log(high))) if log else rng.uniform(low, high)
            point[name] = round(value) if name in WHOLE else value
        trials.append(point)
    return trials


@dataclass
class Bundle:
    """A trained model with what scoring needs."""

    version: str
    model: boosting.Ensemble
    calibrator: IsotonicRegressionModel | None
    threshold: float
    feature_names: list[str] = field(default_factory=lambda: list(S.FEATURES))
    feature_caps: dict[str, float] = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)


def raw_scores(df: DataFrame, model: boosting.Ensemble, names: list[str], caps: dict[str, float]) -> DataFrame:
    """Adds raw_probability, the model's own output."""
    return boosting.scored(model_inputs(df, names, caps), model).drop(*[f"x_{n}" for n in names])


def calibrated(df: DataFrame, calibrator: IsotonicRegressionModel | None) -> DataFrame:
    """Adds fraud_probability in [0, 1]; raw where there is no calibrator."""
    if calibrator is None:
        return df.withColumn("fraud_probability", F.col("raw_probability"))
    return calibrator.transform(df).withColumn(
        "fraud_probability", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("fraud_probability"))))


def score(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Adds raw_probability, fraud_probability, risk_level and model_version."""
    check_contract(df, bundle.feature_names)
    raw = raw_scores(df, bundle.model, bundle.feature_names, bundle.feature_caps)
    return calibrated(raw, bundle.calibrator).withColumns({
        "risk_level": risk_level(F.col("fraud_probability"), bundle.threshold), "model_version": F.lit(bundle.version)})


def fitting_rows(ready: DataFrame, names: list[str], caps: dict[str, float], label: str) -> DataFrame:
    """Inputs, label and weight of the train and validation parts, as boosting takes them."""
    rows = model_inputs(ready.filter(F.col("part").isin("train", "validation")), names, caps)
    return rows.select(*[f"x_{n}" for n in names], F.col(label).cast("boolean").alias("label"), "weight",
                       (F.col("part") == "validation").alias("is_validation"), F.xxhash64("transaction_id").alias("id"))


def train(
    data: DataFrame, version: str, *, n_estimators: int = 5000, max_depth: int = 10, learning_rate: float = 0.1607,
    early_stopping_rounds: int = 100, beta: float = 2.0, n_trials: int = 50, search_rounds: int = SEARCH_ROUNDS,
    skip_tuning: bool = False, seed: int = 42, label: str = "is_fraud", local_rows: int = boosting.LOCAL_ROWS,
) -> Bundle:
    """Fits, calibrates, thresholds and reports a model on training rows (base features + label).

    The model takes at most n_estimators rounds and ends after early_stopping_rounds rounds without gain on the
    validation part. The search fits n_trials points of at most search_rounds rounds each, ended after SEARCH_PATIENCE
    ones without gain, and takes the point with the best average precision there; n_estimators has no bearing on it.
    With skip_tuning the default point is taken, with max_depth and learning_rate as given.
    """
    check_contract(data, [*S.BASE_FEATURES, label])
    rows = encoded(data)
    uncapped = engineer_features(rows)
    caps = fit_caps(uncapped, S.CAPPED_FEATURES)
    names = list(S.FEATURES)
    ready = with_split(evaluate.with_class_weight(uncapped, label), seed, label)
    # Bins, packing and sums read the fitting rows; written, they are computed once.
    path = shared_dir(data.sparkSession, "fitting")
    fitting_rows(ready, names, caps, label).write.parquet(path)
    fitting = data.sparkSession.read.parquet(path)

    params = {**DEFAULT_PARAMS, "max_depth": max_depth, "learning_rate": learning_rate}
    candidates = [] if skip_tuning else trial_params(n_trials, seed)
    if candidates:
        trials = boosting.fit(fitting, names, NOMINAL, candidates, search_rounds, SEARCH_PATIENCE, seed, local_rows)
        params = candidates[max(range(len(trials)), key=lambda i: trials[i].average_precision)]  # the first of equal ones
    model = boosting.fit(fitting, names, NOMINAL, [params], n_estimators, early_stopping_rounds, seed, local_rows)[0].ensemble

    # Scores that are read several times are written: every reading would walk all trees again.
    calibration = written(raw_scores(ready.filter("part = 'calibration'"), model, names, caps).select("raw_probability", label), "calibration")
    calibrator = fit_isotonic(calibration, label)
    threshold = evaluate.fbeta_threshold(calibrated(calibration, calibrator), "fraud_probability", label, beta).first().threshold
    bundle = Bundle(version, model, calibrator, float(threshold), names, caps, {}, {**params, "n_estimators": n_estimators})
    test = written(score(ready.filter("part = 'test'"), bundle).select("fraud_probability", label), "test")
    bundle.metrics = {
        "threshold": bundle.threshold, "threshold_strategy": f"fbeta_{beta}", "beta": beta,
        **evaluate.average_precision(test, "fraud_probability", label).first().asDict(),
        "confusion_matrix": evaluate.confusion(test, "fraud_probability", label, bundle.threshold).first().asDict(),
        **evaluate.classification_report(test, "fraud_probability", label, bundle.threshold).first().asDict(),
    }
    return bundle


def feature_importances(bundle: Bundle, spark, top: int = 15) -> DataFrame:
    """The most important features; at most one row per model feature."""
    weights = bundle.model.importances()
    rows = [(n, float(w)) for n, w in zip(bundle.feature_names, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)
