"""Model bundles on shared storage, and the table of releases."""

from __future__ import annotations

import json

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskflow import schemas as S
from riskflow.ml.boosting import Ensemble
from riskflow.ml.training import Bundle


class ModelLoadError(RuntimeError):
    """A bundle is missing or unreadable."""


def save_bundle(bundle: Bundle, spark: SparkSession, root: str) -> str:
    """Writes the bundle below root and returns its path (<root>/lgbm_<version>)."""
    path = f"{root}/{S.MODEL_PREFIX}{bundle.version}"
    bundle.model.save(spark, f"{path}/model")
    if bundle.calibrator is not None:
        bundle.calibrator.write().overwrite().save(f"{path}/calibrator")
    meta = {
        "version": bundle.version, "threshold": bundle.threshold, "feature_names": bundle.feature_names,
        "feature_caps": bundle.feature_caps, "metrics": bundle.metrics, "params": bundle.params,
        "calibrated": bundle.calibrator is not None, "model_type": "histogram_boosting",
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return path


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
        model = Ensemble.load(spark, f"{path}/model")
        calibrator = IsotonicRegressionModel.load(f"{path}/calibrator") if meta["calibrated"] else None
    except Exception as error:
        raise ModelLoadError(f"no usable model at {path}") from error
    missing = sorted(set(meta["feature_names"]) - set(S.FEATURES))
    if missing:
        raise ModelLoadError("model needs unknown features: " + ", ".join(missing))
    return Bundle(meta["version"], model, calibrator, meta["threshold"], meta["feature_names"], meta["feature_caps"],
                  meta["metrics"], meta["params"])


def publish_release(spark: SparkSession, registry: str, object_name: str, bucket: str, timestamp: int) -> None:
    """Appends a release event to the registry table."""
    row = spark.createDataFrame([(object_name, bucket, timestamp)], S.RELEASE_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(registry)


def releases(spark: SparkSession, registry: str) -> DataFrame:
    return spark.read.schema(S.RELEASE_SCHEMA).parquet(registry).select(
        "object_name", "bucket", F.timestamp_seconds("timestamp").cast("timestamp_ntz").alias("released_at"))


class ActiveModel:
    """The bundle in force: refreshed from the registry at the start of a batch.

    Loads a version once; a release that does not load leaves the current one in place.
    """

    def __init__(self, spark: SparkSession, registry: str, root: str):
        self._spark, self._registry, self._root = spark, registry, root
        self._bundle: Bundle | None = None
        self._tried: str | None = None
        self._bundles: dict[str, Bundle] = {}

    def current(self) -> Bundle:
        from riskflow.operators.registry import latest_model

        newest = latest_model(releases(self._spark, self._registry)).first()
        if newest is not None and newest.object_name != self._tried:
            self._tried = newest.object_name
            try:
                self._bundle = load_bundle(self._spark, f"{self._root}/{newest.object_name}")
            except ModelLoadError:
                if self._bundle is None:
                    raise
        if self._bundle is None:
            raise ModelLoadError("no model released")
        return self._bundle

    def in_force(self, low: int, high: int) -> list[tuple[int, Bundle]]:
        """(first second, bundle) of the releases in force between two event seconds, in order of time.

        A release that does not load leaves the one before it in force; before the first release its bundle is
        taken. As many bundles as there are releases in that span, and one.
        """
        seconds = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("released_at"))
        from riskflow.operators.registry import model_objects

        known = model_objects(releases(self._spark, self._registry)).select(seconds.alias("sec"), "object_name")
        started = known.filter(F.col("sec") <= low).orderBy(F.desc("sec"), F.desc("object_name"))
        spans: list[tuple[int, Bundle]] = []
        for r in known.filter((F.col("sec") > low) & (F.col("sec") <= high)).orderBy("sec", "object_name").collect():
            bundle = self._loaded(r.object_name)
            if bundle is not None:
                spans.append((r.sec, bundle))
        for r in started.toLocalIterator():  # the newest first, until one loads
            bundle = self._loaded(r.object_name)
            if bundle is not None:
                return [(r.sec, bundle), *spans]
        if not spans:
            raise ModelLoadError("no model released")
        return spans

    def _loaded(self, name: str) -> Bundle | None:
        if name not in self._bundles:
            try:
                self._bundles[name] = load_bundle(self._spark, f"{self._root}/{name}")
            except ModelLoadError:
                return None
        return self._bundles[name]
