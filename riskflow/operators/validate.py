"""Record checks: transaction rules, feature ranges, references, model contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskflow import schemas as S
from riskflow.functions.scalar import is_blank

# --- fixed values: rule messages -------------------------------------------------------------
NOT_BLANK = "must not be blank"
NOT_NULL = "must not be null"
POSITIVE = "must be greater than 0"
PAST = "must be a date in the past or in the present"
KNOWN_COUNTRY = "must be a known country code"


def _violation(field: str, message: str, failed: Column) -> Column:
    return F.when(failed, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def transaction_violations(now: Column, *, require_id: bool = False) -> Column:
    """Array of {field, message}; empty for a valid row. Device and address are optional."""
    c = F.col
    rules = [
        *([_violation("transactionId", NOT_BLANK, is_blank(c("transaction_id")))] if require_id else []),
        _violation("userId", NOT_BLANK, is_blank(c("user_id"))),
        _violation("cardId", NOT_BLANK, is_blank(c("card_id"))),
        _violation("merchantId", NOT_BLANK, is_blank(c("merchant_id"))),
        _violation("amount", NOT_NULL, c("amount").isNull()),
        _violation("amount", POSITIVE, c("amount") <= 0),
        _violation("countryCode", NOT_NULL, c("country_code").isNull()),
        _violation("countryCode", KNOWN_COUNTRY, ~c("country_code").isin(S.COUNTRIES)),
        _violation("creationDateTime", NOT_NULL, c("creation_date_time").isNull()),
        _violation("creationDateTime", PAST, c("creation_date_time") > now),
    ]
    return F.array_compact(F.array(*rules))


def validate_transactions(df: DataFrame, now: Column, *, require_id: bool = False) -> DataFrame:
    """Adds `violations`; `now` is a parameter so that reruns agree."""
    return df.withColumn("violations", transaction_violations(now, require_id=require_id))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the violations column, rejected rows with it)."""
    return df.filter(F.size("violations") == 0).drop("violations"), df.filter(F.size("violations") > 0)


def violation_message(violations: Column) -> Column:
    return F.concat(
        F.lit("Validation failed: "),
        F.array_join(F.transform(violations, lambda v: F.concat(F.lit("["), v.field, F.lit(": "), v.message, F.lit("]"))), " "),
    )


def default_transaction_id(df: DataFrame) -> DataFrame:
    """Gives rows without an id a fresh one; supplied ids stay."""
    return df.withColumn(
        "transaction_id", F.when(is_blank(F.col("transaction_id")), F.expr("uuid()")).otherwise(F.col("transaction_id")))


def dead_letters(rejected: DataFrame, topic: str) -> DataFrame:
    """Quarantine rows: topic, reason and the record itself."""
    record = F.struct(*[F.col(c) for c in rejected.columns if c != "violations"])
    return rejected.select(
        F.lit(topic).alias("topic"), violation_message(F.col("violations")).alias("reason"),
        F.to_json(record).alias("record"),
    )


def dead_letter_counts(letters: DataFrame) -> DataFrame:
    return letters.groupBy("topic").agg(F.count("*").alias("dead_letters"))


# --- fixed values: allowed feature ranges (lower, upper) ---------------------------------------
FEATURE_RANGES: dict[str, tuple[float | None, float | None]] = {
    "user_average_amount": (0, None),
    "user_historical_transaction_count": (0, None),
    "user_transaction_count_5min": (0, None),
    "user_transaction_count_1hour": (0, None),
    "seconds_since_last_transaction": (0, None),
    "amount_velocity_1hour": (0, None),
    "merchant_risk_score": (0, 1),
    "amount_to_average_ratio": (0, None),
    "hour_of_day": (0, 23),
    "ip_risk_score": (0, 1),
    "card_age_days": (0, None),
    "user_account_age_days": (0, None),
    "day_of_week": (1, 7),
    "merchant_category": (0, 7),
    "card_type": (0, 3),
    "distinct_merchant_count_1hour": (0, None),
}
REQUIRED_FEATURES = [f for f in S.BASE_FEATURES if f not in S.FEATURE_DEFAULTS]


def validate_features(df: DataFrame) -> DataFrame:
    """Adds `feature_violations`: names of required features missing or features out of range."""
    checks = [F.when(~(F.col("amount") > 0), F.lit("amount"))]
    for name, (low, high) in FEATURE_RANGES.items():
        if name in df.columns:
            bad = F.lit(False)
            bad = bad | (F.col(name) < low) if low is not None else bad
            bad = bad | (F.col(name) > high) if high is not None else bad
            checks.append(F.when(bad, F.lit(name)))
    checks += [F.when(F.col(n).isNull(), F.lit(n)) for n in REQUIRED_FEATURES if n in df.columns]
    return df.withColumn("feature_violations", F.array_distinct(F.array_compact(F.array(*checks))))


def fill_feature_defaults(df: DataFrame) -> DataFrame:
    """Optional features left out become their defaults, as a value or as a whole column."""
    filled = {
        n: F.coalesce(F.col(n), F.lit(v).cast(df.schema[n].dataType)) if n in df.columns else F.lit(v)
        for n, v in S.FEATURE_DEFAULTS.items()
    }
    return df.withColumns(filled)


class FeatureContractError(ValueError):
    """The data cannot provide features the model needs."""


def check_contract(df: DataFrame, required: list[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise FeatureContractError("Missing required features: " + ", ".join(missing))


def contract_report(df: DataFrame, required: list[str]) -> DataFrame:
    """feature, available, present (rows that have a value; 0 where the column is missing): a row a required feature."""
    counts = df.agg(*[F.count(n).alias(n) if n in df.columns else F.lit(0).cast("long").alias(n) for n in required])
    listed = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(n in df.columns).alias("available"), F.col(n).alias("present")) for n in required])
    return counts.select(F.inline(listed))


def check_references(
    tx: DataFrame, users: DataFrame, merchants: DataFrame, cards: DataFrame, devices: DataFrame | None
) -> DataFrame:
    """Adds `missing_reference`: the first absent of user, merchant, card, device; null if none.

    Each dimension joins on its distinct ids; a blank device is allowed, and `devices=None` leaves
    devices unchecked.
    """
    dims = {"user": users, "merchant": merchants, "card": cards, **({"device": devices} if devices is not None else {})}
    out, missing = tx, None
    for name, dim in dims.items():
        known = dim.select(F.col(f"{name}_id").alias("_id")).distinct().withColumn(f"_has_{name}", F.lit(True))
        key = spread_null_key(F.col(f"{name}_id"), F.col("transaction_id"))
        out = out.join(known, key == F.col("_id"), "left").drop("_id")
        absent = F.col(f"_has_{name}").isNull()
        if name == "device":
            absent = absent & ~is_blank(F.col("device_id"))
        missing = F.when(absent, name) if missing is None else missing.when(absent, name)
    return out.withColumn("missing_reference", missing).drop(*[f"_has_{n}" for n in dims])


def spread_null_key(key: Column, spread_by: Column) -> Column:
    """Join key that matches as `key` but does not send all blank rows to one task."""
    return F.when(is_blank(key), F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(spread_by), F.lit(4096)).cast("string"))).otherwise(key)


def normalise_feature_names(df: DataFrame) -> DataFrame:
    """Message field names (camelCase) become column names."""
    return df.withColumnsRenamed({**S.MESSAGE_COLUMN_NAMES, **S.MESSAGE_FEATURE_NAMES})


def insert_if_absent(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows to append: those whose key the target lacks, one per key.

    The row kept among several with one key is the smallest, so a rerun picks the same.
    """
    fresh = rows.join(target.select(key).distinct(), key, "left_anti")
    others = [c for c in rows.columns if c != key]
    picked = fresh.groupBy(key).agg(F.min(F.struct(*others)).alias("_r"))
    return picked.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def deduplicate(tx: DataFrame) -> DataFrame:
    """One row per transaction id: a redelivered event counts once."""
    others = [c for c in tx.columns if c != "transaction_id"]
    return tx.groupBy("transaction_id").agg(F.min(F.struct(*others)).alias("_r")).select(
        *[F.col(c) if c == "transaction_id" else F.col(f"_r.{c}").alias(c) for c in tx.columns])


def route_failures(df: DataFrame, error: Column, attempts: Column, *, max_retries: int = 3,
                   initial_ms: int = 1000, multiplier: int = 2, max_ms: int = 10_000) -> DataFrame:
    """Adds `route` and `delay_ms` for a failed record.

    Validation errors go to the dead letters at once; others retry with doubling, bounded delays
    until the retries are used up.
    """
    delay = F.least(F.lit(max_ms), F.lit(initial_ms) * F.pow(F.lit(multiplier), attempts)).cast("long")
    route = (
        F.when(error.isNull(), "ok").when(error == "validation", "dead_letter")
        .when(attempts >= max_retries, "dead_letter").otherwise("retry")
    )
    return df.withColumn("route", route).withColumn("delay_ms", F.when(F.col("route") == "retry", delay))
