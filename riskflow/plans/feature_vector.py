"""The 31-column feature vector of every transaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskflow import schemas as S
from riskflow.functions.scalar import (
    amount_to_average_ratio, engineered, hour_of_day, iso_weekday, whole_days,
)
from riskflow.operators.enrich import enrich
from riskflow.operators.history import address_key, with_address_risk, with_predictions
from riskflow.operators.ordered import MAX_GROUP_ROWS, large_groups
from riskflow.operators.user_windows import USER_COLUMNS, user_features


@dataclass(frozen=True)
class Dimensions:
    users: DataFrame
    merchants: DataFrame
    cards: DataFrame
    devices: DataFrame


def base_features(
    tx: DataFrame, dims: Dimensions, predictions: DataFrame, *, ttl_seconds: int | None = None,
    safe_only: bool = False, max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """The nineteen base features next to the transaction's own columns.

    The histories are one narrow table: predictions are joined to it by id, it moves once by user and once by
    address and meets the wide rows by id, so those move once. Windows, ages and histories use event time. Every
    row of tx comes back; what a row lacks the keys for is null. Ids are expected to be unique
    (`validate.deduplicate`).
    """
    narrow = tx.select("transaction_id", "user_id", "merchant_id", "amount", "ip_address", "creation_date_time")
    addresses = narrow.withColumn("_address", address_key()).filter("startswith(_address, '+')")
    large_addresses = large_groups(addresses, ["_address"], max_group_rows)
    by_user = user_features(
        with_predictions(narrow, predictions.select("transaction_id", "risk_level", "is_marked_as_safe")),
        ttl_seconds=ttl_seconds, safe_only=safe_only, max_group_rows=max_group_rows,
        large_users=large_groups(tx, ["user_id"], max_group_rows))
    histories = with_address_risk(
        by_user.withColumn("_address", address_key()), large_addresses, max_group_rows=max_group_rows)
    rows = enrich(tx, dims.users, dims.merchants, dims.cards, dims.devices)
    ts = F.col("creation_date_time")
    return (
        rows.join(histories.select("transaction_id", *USER_COLUMNS, "ip_risk_score"), "transaction_id", "left")
        .withColumns({
            "ip_risk_score": F.coalesce("ip_risk_score", F.lit(0.0)),
            "amount_to_average_ratio": amount_to_average_ratio(F.col("amount"), F.col("user_average_amount")),
            "hour_of_day": hour_of_day(ts),
            "day_of_week": iso_weekday(ts),
            "card_age_days": whole_days(F.col("card_created_at"), ts),
            "user_account_age_days": whole_days(F.col("user_created_at"), ts),
        })
    )


def engineer_features(df: DataFrame, caps: dict[str, float] | None = None) -> DataFrame:
    """Adds the twelve derived features in one projection; caps bound the two interactions."""
    return df.withColumns(engineered(caps))


def feature_vector(tx: DataFrame, dims: Dimensions, predictions: DataFrame, *, caps: dict[str, float] | None = None,
                   **modes) -> DataFrame:
    """transaction_id and the 31 features in model order."""
    return engineer_features(base_features(tx, dims, predictions, **modes), caps).select("transaction_id", *S.FEATURES)


def numeric_features(df: DataFrame, names: list[str] = S.FEATURES) -> DataFrame:
    """Features as doubles (booleans 0/1), other columns untouched."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})
