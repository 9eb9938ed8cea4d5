"""Column expressions: text tests, time, encodings, risk tiers, engineered features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskflow import schemas as S


#: White space of a blank text: tabs, line ends and every space but the non-breaking ones.
_BLANK = r"\A[\t-\r\x1c-\x1f \u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]*\z"


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(_BLANK)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def normalize_epoch(value: Column) -> Column:
    """Milliseconds become seconds; seconds stay."""
    return F.when(value > S.EPOCH_MILLIS_FROM, F.floor(value / 1000)).otherwise(value).cast("long")


def member_amount(member: Column) -> Column:
    """Amount after the last ':'; null where the member has none."""
    suffix = F.substring_index(member, ":", -1)
    return F.when(F.contains(member, F.lit(":")) & (suffix != ""), suffix.try_cast(S.MONEY))


def member_merchant(member: Column) -> Column:
    """Merchant after the last ':'; the whole member where there is none."""
    suffix = F.substring_index(member, ":", -1)
    return F.when(F.contains(member, F.lit(":")) & (suffix != ""), suffix).otherwise(member)


def ordinal(c: Column, domain: list[str], default: int) -> Column:
    """Position of a name in its domain; unknown and null take the default."""
    mapping = F.create_map(*[F.lit(x) for i, name in enumerate(domain) for x in (name, i)])
    return F.coalesce(F.try_element_at(mapping, c), F.lit(default)).cast("int")


def encode_category(c: Column) -> Column:
    return ordinal(c, S.MERCHANT_CATEGORIES, 7)


def encode_card_type(c: Column) -> Column:
    return ordinal(c, S.CARD_TYPES, 3)


def risk_level(probability: Column, threshold: float | Column) -> Column:
    """Tier relative to the model threshold: HIGH from it, MEDIUM from half of it."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (
        F.when(probability >= t, "HIGH")
        .when(probability >= t * S.MEDIUM_SHARE_OF_THRESHOLD, "MEDIUM")
        .otherwise("LOW")
    )


def risk_band(probability: Column) -> Column:
    """Tier by fixed bands, both strict."""
    return (
        F.when(probability > S.HIGH_BAND, "HIGH")
        .when(probability > S.MEDIUM_BAND, "MEDIUM")
        .otherwise("LOW")
    )


def is_safe(probability: Column) -> Column:
    return probability < S.HIGH_BAND


def at_least(c: Column, bound: float) -> Column:
    """Lower clip that keeps nulls (greatest alone would drop them)."""
    return F.when(c.isNotNull(), F.greatest(c.cast("double"), F.lit(float(bound))))


def at_most(c: Column, bound: float | None) -> Column:
    """Upper clip that keeps nulls (least alone would drop them)."""
    if bound is None:
        return c
    return F.when(c.isNotNull(), F.least(c.cast("double"), F.lit(float(bound))))


def whole_days(start: Column, end: Column) -> Column:
    """Completed 24-hour periods between two zone-less timestamps."""
    return F.floor((epoch_seconds(end) - epoch_seconds(start)) / 86400).cast("long")


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def iso_weekday(ts: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(ts) + 1


def amount_to_average_ratio(amount: Column, average: Column) -> Column:
    """Four decimals, half up, in decimal arithmetic."""
    divisor = F.greatest(average.cast("decimal(24,10)"), F.lit(1).cast("decimal(24,10)"))
    return F.round(amount.cast(S.MONEY) / divisor, 4).cast("double")


def engineered(caps: dict[str, float] | None = None) -> dict[str, Column]:
    """The twelve derived features, from the base-feature columns of the same row."""
    caps = caps or {}
    num = lambda name: F.col(name).cast("double")
    amount, average, ratio = num("amount"), num("user_average_amount"), num("amount_to_average_ratio")
    merchant_risk, ip_risk = num("merchant_risk_score"), num("ip_risk_score")
    n5, n60 = num("user_transaction_count_5min"), num("user_transaction_count_1hour")
    since, velocity, hour = (
        num("seconds_since_last_transaction"), num("amount_velocity_1hour"), F.col("hour_of_day"))
    return {
        "log_amount": F.log1p(amount),
        "log_seconds_since": F.log1p(since),
        "log_velocity_1hour": F.log1p(velocity),
        "amount_x_merchant_risk": at_most(amount * merchant_risk, caps.get("amount_x_merchant_risk")),
        "risk_score_product": merchant_risk * ip_risk,
        "ip_device_risk": ip_risk * (1.0 - num("is_device_trusted")),
        "country_ip_risk": num("has_country_mismatch") * ip_risk,
        "velocity_amount_interaction": at_most(n60 * ratio, caps.get("velocity_amount_interaction")),
        "recency_velocity": n5 / at_least(since, 1),
        "amount_deviation": F.abs(amount - average) / at_least(average, 1),
        "is_night": ((hour < 6) | (hour >= 22)),
        "velocity_intensity": velocity / at_least(n60, 1),
    }


def hashed_uniform(seed: int, *cols: Column) -> Column:
    """Repeatable number in [0, 1) from a row's own columns, independent of partitioning."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
