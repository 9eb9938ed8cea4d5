"""Event messages: parse created transactions, build scored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskflow import schemas as S

_CORRUPT = "_corrupt"


def parsed(df: DataFrame, value: str = "value") -> DataFrame:
    """The transaction columns, the `record` text and whether it was `readable`."""
    schema = T.StructType([*S.MESSAGE_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    text = F.col(value).cast("string")
    message = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return df.select(text.alias("record"), message.alias("_m")).select(
        *[F.col(f"_m.{m}").alias(c) for m, c in S.MESSAGE_COLUMN_NAMES.items()], "record",
        (F.col("_m").isNotNull() & F.col(f"_m.{_CORRUPT}").isNull()).alias("readable"))


def parse_created(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(transactions, unreadable records): a record that is no valid JSON never stops the reader."""
    rows = parsed(df, value)
    return rows.filter("readable").select(*S.TRANSACTION_SCHEMA.names), rows.filter("NOT readable").select("record")


def created_value() -> Column:
    """JSON value of a created-transaction message, from the transaction columns."""
    return F.to_json(F.struct(*[F.col(c).alias(m) for m, c in S.MESSAGE_COLUMN_NAMES.items()]))


def nest_scored(df: DataFrame) -> DataFrame:
    """Flat scored row to the message layout: nine fields, featuresMessage, predictionMessage.

    Missing contributions become an empty list.
    """
    if "contributions" in df.columns:
        top = F.coalesce(F.col("contributions"), F.array().cast(f"array<{S.CONTRIBUTION_TYPE.simpleString()}>"))
    else:
        top = F.array().cast(f"array<{S.CONTRIBUTION_TYPE.simpleString()}>")
    return df.select(
        *[F.col(c).alias(m) for m, c in S.MESSAGE_COLUMN_NAMES.items()],
        F.struct(*[F.col(c).alias(m) for m, c in S.MESSAGE_FEATURE_NAMES.items()]).alias("featuresMessage"),
        F.struct(
            F.col("fraud_probability").alias("fraudProbability"), F.col("risk_level").alias("riskLevel"),
            F.col("model_version").alias("modelVersion"), F.struct(top.alias("top_contributing_features")).alias("explainability"),
        ).alias("predictionMessage"),
    )


def scored_records(df: DataFrame) -> DataFrame:
    """key and JSON value, ready for a keyed sink."""
    nested = nest_scored(df)
    return nested.select(F.col("transactionId").alias("key"), F.to_json(F.struct(*nested.columns)).alias("value"))


def flatten_scored(nested: DataFrame) -> DataFrame:
    """Message layout back to a flat row."""
    return nested.select(
        *[F.col(m).alias(c) for m, c in S.MESSAGE_COLUMN_NAMES.items()],
        *[F.col(f"featuresMessage.{m}").alias(c) for m, c in S.MESSAGE_FEATURE_NAMES.items()],
        F.col("predictionMessage.fraudProbability").alias("fraud_probability"),
        F.col("predictionMessage.riskLevel").alias("risk_level"),
        F.col("predictionMessage.modelVersion").alias("model_version"),
        F.coalesce(F.col("predictionMessage.explainability.top_contributing_features"),
                   F.array().cast(f"array<{S.CONTRIBUTION_TYPE.simpleString()}>")).alias("contributions"),
    )
