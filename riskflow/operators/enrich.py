"""Dimension lookups for transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskflow.functions.scalar import encode_card_type, encode_category
from riskflow.operators.validate import spread_null_key


def with_user(tx: DataFrame, users: DataFrame) -> DataFrame:
    """Home country and account creation of the user; null where the user is unknown."""
    return tx.join(
        users.select("user_id", "home_country_code", F.col("creation_date_time").alias("user_created_at")),
        "user_id", "left",
    )


def with_merchant(tx: DataFrame, merchants: DataFrame) -> DataFrame:
    return tx.join(
        merchants.select(
            "merchant_id", F.col("risk_score").alias("merchant_risk_score"),
            encode_category(F.col("category")).alias("merchant_category")),
        "merchant_id", "left",
    )


def with_card(tx: DataFrame, cards: DataFrame) -> DataFrame:
    return tx.join(
        cards.select(
            "card_id", encode_card_type(F.col("type")).alias("card_type"),
            F.col("creation_date_time").alias("card_created_at")),
        "card_id", "left",
    )


def with_device_trust(tx: DataFrame, devices: DataFrame) -> DataFrame:
    """True where the device id is given and known. Rows without one are spread over the join."""
    known = devices.select(F.col("device_id").alias("_known")).distinct()
    key = spread_null_key(F.col("device_id"), F.col("transaction_id"))
    return (
        tx.join(known, key == F.col("_known"), "left")
        .withColumn("is_device_trusted", F.col("_known").isNotNull()).drop("_known")
    )


def with_country_mismatch(enriched: DataFrame) -> DataFrame:
    return enriched.withColumn("has_country_mismatch", F.col("home_country_code") != F.col("country_code"))


def enrich(tx: DataFrame, users: DataFrame, merchants: DataFrame, cards: DataFrame, devices: DataFrame) -> DataFrame:
    """All lookups. Dimension sizes decide the join: small ones are broadcast by the optimiser,
    others are sort-merged with runtime skew splitting."""
    out = with_device_trust(with_card(with_merchant(with_user(tx, users), merchants), cards), devices)
    return with_country_mismatch(out)


def split_enriched(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with user, merchant and card found, rows to quarantine)."""
    found = F.col("home_country_code").isNotNull() & F.col("merchant_category").isNotNull() & F.col("card_type").isNotNull()
    return enriched.filter(found), enriched.filter(~found)
