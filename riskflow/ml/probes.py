"""Behavioural probes: six fixed situations a model is asked about after training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskflow.ml.training import Bundle, encoded, score
from riskflow.plans.feature_vector import engineer_features

_COLUMNS = """
    probe string, amount double, user_average_amount double, user_historical_transaction_count long,
    user_transaction_count_5min long, user_transaction_count_1hour long, seconds_since_last_transaction long,
    amount_velocity_1hour double, merchant_risk_score double, is_device_trusted boolean, has_country_mismatch boolean,
    amount_to_average_ratio double, hour_of_day int, ip_risk_score double, card_age_days long, user_account_age_days long,
    day_of_week int, merchant_category string, card_type string, distinct_merchant_count_1hour long"""

# --- fixed values: the probes, in the column order above ---------------------------------------
PROBES = [
    ("ordinary_first_transaction", 85.0, 90.0, 0, 0, 0, 2592000, 85.0, 0.10, True, False,
     0.9444, 14, 0.05, 180, 220, 2, "GROCERY", "CREDIT", 1),
    ("established_moderate_mild_risk", 450.0, 220.0, 24, 0, 1, 7200, 450.0, 0.35, True, False,
     2.0455, 16, 0.20, 500, 700, 3, "RESTAURANT", "CREDIT", 1),
    ("large_first_transaction_low_context_risk", 1000000.0, 100.0, 0, 0, 0, 2592000, 1000000.0, 0.12, True, False,
     10000.0, 13, 0.05, 120, 140, 2, "GROCERY", "CREDIT", 1),
    ("large_first_transaction_untrusted_device", 1000000.0, 100.0, 0, 0, 0, 2592000, 1000000.0, 0.12, False, False,
     10000.0, 13, 0.05, 120, 140, 2, "GROCERY", "CREDIT", 1),
    ("large_first_transaction_risky_context", 1000000.0, 100.0, 0, 0, 0, 2592000, 1000000.0, 0.88, False, True,
     10000.0, 2, 0.91, 3, 5, 7, "TRAVEL", "CREDIT", 1),
    ("small_velocity_burst", 25.0, 65.0, 18, 7, 9, 35, 380.0, 0.25, False, False,
     0.3846, 1, 0.35, 300, 500, 6, "OTHER", "DEBIT", 5),
]


def probe_features(spark: SparkSession) -> DataFrame:
    """The probes with all 31 features, uncapped."""
    return engineer_features(encoded(spark.createDataFrame(PROBES, _COLUMNS)))


def score_probes(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """probe and its probability, with the caps the model was trained under."""
    return score(probe_features(spark), bundle).select("probe", F.col("fraud_probability"))
