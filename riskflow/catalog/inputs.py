"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskflow import schemas as S
from riskflow.plans.feature_vector import Dimensions, base_features, engineer_features
from riskflow.session import shared_dir
from riskflow.sources.derived import derived

_written: dict[tuple[str, str, str], str] = {}


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "transactions")


def transaction_table(spark: SparkSession, sf: str) -> DataFrame:
    """The transactions as a written table, for plans that scan them several times.

    Input with fewer splits than cores is spread over them; larger input is written as it comes.
    """

    def build(path: str) -> None:
        df = transactions(spark, sf)
        cores = spark.sparkContext.defaultParallelism
        (df.repartition(cores) if df.rdd.getNumPartitions() < cores else df).write.parquet(path)

    return spark.read.parquet(once(spark, sf, "transactions", build))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "predictions")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return transactions(spark, sf).join(predictions(spark, sf), "transaction_id")


def dimensions(spark: SparkSession, sf: str) -> Dimensions:
    return Dimensions(*(derived(spark, sf, n) for n in ("users", "merchants", "cards", "devices")))


def once(spark: SparkSession, sf: str, name: str, build) -> str:
    """Path of a table written once per session and input directory: reports share it instead of
    each recomputing the features."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        path = shared_dir(spark, name)
        build(path)
        _written[key] = path
    return _written[key]


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """All 31 features with ids, label and the transaction's own columns."""

    def build(path: str) -> None:
        df = engineer_features(base_features(transaction_table(spark, sf), dimensions(spark, sf), predictions(spark, sf)))
        own = ["transaction_id", "user_id", "card_id", "merchant_id", "device_id", "country_code", "ip_address", "creation_date_time"]
        df.select(*own, *S.FEATURES, "is_fraud").write.parquet(path)

    return spark.read.parquet(once(spark, sf, "feature_table", build))


def training_set(spark: SparkSession, sf: str) -> DataFrame:
    return feature_table(spark, sf).select(*S.TRAINING_COLUMNS)


def rounded(df: DataFrame, places: int = 6, digits: dict[str, int] | None = None) -> DataFrame:
    """Doubles and decimals as doubles of fixed precision, for comparison across engines."""
    digits = digits or {}
    return df.select(*[
        F.round(F.col(f.name).cast("double"), digits.get(f.name, places)).alias(f.name)
        if f.dataType.typeName() in ("double", "float", "decimal") else F.col(f.name)
        for f in df.schema.fields
    ])
