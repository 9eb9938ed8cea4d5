"""File sources and sinks: training CSV, message streams, JDBC tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskflow import schemas as S


class TrainingDataError(RuntimeError):
    """A training file could not be read."""


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Training rows with a fixed schema: no inference pass. A missing path fails here."""
    try:
        return spark.read.schema(S.TRAINING_SCHEMA).option("header", True).csv(path)
    except PySparkException as error:
        raise TrainingDataError(f"cannot read training data at {path}") from error


def write_training_csv(df: DataFrame, path: str) -> None:
    """Header and one line a row, one file per task; encoded categories are written as names."""
    def name(column: str, domain: list[str]):
        return F.try_element_at(F.array(*[F.lit(x) for x in domain]), F.col(column) + 1).alias(column)

    encoded = {"merchant_category": S.MERCHANT_CATEGORIES, "card_type": S.CARD_TYPES}
    columns = [
        name(c, encoded[c]) if c in encoded and df.schema[c].dataType.typeName() != "string" else F.col(c)
        for c in S.TRAINING_COLUMNS
    ]
    df.select(*columns).write.option("header", True).csv(path)


def read_transactions_stream(spark: SparkSession, path: str | None = None, *, files_per_batch: int = 100,
                             kafka: dict[str, str] | None = None) -> DataFrame:
    """Streaming `value` column of created-transaction messages, from the earliest offset.

    Text files below `path`, or a Kafka topic given by its source options where that connector is
    on the classpath.
    """
    if kafka is not None:
        return (
            spark.readStream.format("kafka").option("startingOffsets", "earliest").options(**kafka).load()
            .select(F.col("key").cast("string"), F.col("value").cast("string"))
        )
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def read_jdbc_table(spark: SparkSession, url: str, name: str, *, column: str, lower: str, upper: str,
                    partitions: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A relational table read by ranges of one column, a task per range."""
    return spark.read.jdbc(url, name, column=column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})
