"""Record layouts, value domains and the 31-column feature contract."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: domains, in their ordinal order -------------------------------------------
COUNTRIES = [
    "AR", "AU", "BR", "CA", "CH", "CL", "CN", "DE", "ES", "FR",
    "GB", "IN", "IT", "JP", "MX", "NL", "PT", "SE", "US", "ZA",
]
MERCHANT_CATEGORIES = [
    "GROCERY", "RESTAURANT", "ENTERTAINMENT", "TRAVEL",
    "HEALTHCARE", "EDUCATION", "UTILITIES", "OTHER",
]
CARD_TYPES = ["CREDIT", "DEBIT", "CREDIT_AND_DEBIT", "OTHER"]
DEVICE_TYPES = ["CELLPHONE", "LAPTOP", "DESKTOP", "POS", "OTHER"]
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH"]
TASK_STATUSES = ["PENDING_LLM", "PENDING_EMAIL", "COMPLETED", "DEAD_LETTER"]

# --- fixed values: windows, defaults, thresholds ---------------------------------------------
FIVE_MINUTES = 300
ONE_HOUR = 3600
NO_PREVIOUS_SECONDS = 2_592_000
SESSION_TTL_SECONDS = 600
COLD_START_AVERAGE = 100.0
EPOCH_MILLIS_FROM = 10_000_000_000
LARGE_AMOUNT = 10_000
MEDIUM_SHARE_OF_THRESHOLD = 0.5
HIGH_BAND, MEDIUM_BAND = 0.70, 0.30
MAX_ATTEMPTS, BASE_DELAY_SECONDS, DUE_BATCH = 5, 30, 50
MODEL_PREFIX = "lgbm_"

# --- fixed values: histogram upper bounds ----------------------------------------------------
PROBABILITY_BOUNDS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0]
DURATION_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]

# --- fixed values: report buckets ------------------------------------------------------------
AMOUNT_EDGES = [0, 100, 1_000, 10_000, 100_000]
AMOUNT_LABELS = ["<=100", "100-1k", "1k-10k", "10k-100k", ">100k"]
RATIO_EDGES = [0, 1.1, 2, 5, 20]
RATIO_LABELS = ["<=1.1", "1.1-2", "2-5", "5-20", ">20"]
MIN_MEAN_OVERLAP, MAX_FEATURE_AUC, MIN_COLD_LIFT = 0.55, 0.78, 2.0

# --- fixed values: feature names in model order ----------------------------------------------
BASE_FEATURES = [
    "amount",
    "user_average_amount",
    "user_historical_transaction_count",
    "user_transaction_count_5min",
    "user_transaction_count_1hour",
    "seconds_since_last_transaction",
    "amount_velocity_1hour",
    "merchant_risk_score",
    "is_device_trusted",
    "has_country_mismatch",
    "amount_to_average_ratio",
    "hour_of_day",
    "ip_risk_score",
    "card_age_days",
    "user_account_age_days",
    "day_of_week",
    "merchant_category",
    "card_type",
    "distinct_merchant_count_1hour",
]
ENGINEERED_FEATURES = [
    "log_amount",
    "log_seconds_since",
    "log_velocity_1hour",
    "amount_x_merchant_risk",
    "risk_score_product",
    "ip_device_risk",
    "country_ip_risk",
    "velocity_amount_interaction",
    "recency_velocity",
    "amount_deviation",
    "is_night",
    "velocity_intensity",
]
FEATURES = BASE_FEATURES + ENGINEERED_FEATURES
CAPPED_FEATURES = ["amount_x_merchant_risk", "velocity_amount_interaction"]
TRAINING_COLUMNS = ["transaction_id", "user_id", *BASE_FEATURES, "is_fraud"]

# Message field name -> column name; two engineered features are renamed on the way.
MESSAGE_FEATURE_NAMES = {
    "userAverageAmount": "user_average_amount",
    "userHistoricalTransactionCount": "user_historical_transaction_count",
    "userTransactionCount5Min": "user_transaction_count_5min",
    "userTransactionCount1Hour": "user_transaction_count_1hour",
    "secondsSinceLastTransaction": "seconds_since_last_transaction",
    "merchantRiskScore": "merchant_risk_score",
    "isDeviceTrusted": "is_device_trusted",
    "hasCountryMismatch": "has_country_mismatch",
    "amountToAverageRatio": "amount_to_average_ratio",
    "hourOfDay": "hour_of_day",
    "ipRiskScore": "ip_risk_score",
    "cardAgeDays": "card_age_days",
    "amountVelocity1Hour": "amount_velocity_1hour",
    "userAccountAgeDays": "user_account_age_days",
    "dayOfWeek": "day_of_week",
    "merchantCategory": "merchant_category",
    "cardType": "card_type",
    "distinctMerchantCount1Hour": "distinct_merchant_count_1hour",
    "logAmount": "log_amount",
    "logSecondsSinceLastTransaction": "log_seconds_since",
    "logVelocity1Hour": "log_velocity_1hour",
    "amountTimesMerchantRisk": "amount_x_merchant_risk",
    "riskScoreProduct": "risk_score_product",
    "ipDeviceRisk": "ip_device_risk",
    "countryIpRisk": "country_ip_risk",
    "velocityAmountInteraction": "velocity_amount_interaction",
    "recencyVelocity": "recency_velocity",
    "amountDeviation": "amount_deviation",
    "isNight": "is_night",
    "velocityIntensity": "velocity_intensity",
}
MESSAGE_COLUMN_NAMES = {
    "transactionId": "transaction_id",
    "userId": "user_id",
    "cardId": "card_id",
    "merchantId": "merchant_id",
    "deviceId": "device_id",
    "amount": "amount",
    "countryCode": "country_code",
    "ipAddress": "ip_address",
    "creationDateTime": "creation_date_time",
}

# Values an optional feature takes when the request leaves it out.
FEATURE_DEFAULTS = {
    "amount_velocity_1hour": 0.0,
    "user_account_age_days": 0,
    "day_of_week": 1,
    "merchant_category": 7,
    "card_type": 3,
    "distinct_merchant_count_1hour": 0,
    **{name: 0.0 for name in ENGINEERED_FEATURES},
}

MONEY = T.DecimalType(19, 2)

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("card_id", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("country_code", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("creation_date_time", T.TimestampNTZType()),
])
MESSAGE_SCHEMA = T.StructType([
    T.StructField(name, TRANSACTION_SCHEMA[column].dataType)
    for name, column in MESSAGE_COLUMN_NAMES.items()
])
USER_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("birth_date", T.DateType()),
    T.StructField("home_country_code", T.StringType()),
    T.StructField("creation_date_time", T.TimestampNTZType()),
])
MERCHANT_SCHEMA = T.StructType([
    T.StructField("merchant_id", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("risk_score", T.FloatType()),
    T.StructField("category", T.StringType()),
    T.StructField("creation_date_time", T.TimestampNTZType()),
])
CARD_SCHEMA = T.StructType([
    T.StructField("card_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("creation_date_time", T.TimestampNTZType()),
])
DEVICE_SCHEMA = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("creation_date_time", T.TimestampNTZType()),
])
PREDICTION_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("fraud_probability", T.DoubleType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("is_marked_as_safe", T.BooleanType()),
])
RELEASE_SCHEMA = T.StructType([
    T.StructField("object_name", T.StringType()),
    T.StructField("bucket", T.StringType()),
    T.StructField("timestamp", T.LongType()),
])
_FEATURE_TYPES = {
    "user_historical_transaction_count": T.LongType(),
    "user_transaction_count_5min": T.LongType(),
    "user_transaction_count_1hour": T.LongType(),
    "seconds_since_last_transaction": T.LongType(),
    "is_device_trusted": T.BooleanType(),
    "has_country_mismatch": T.BooleanType(),
    "hour_of_day": T.IntegerType(),
    "card_age_days": T.LongType(),
    "user_account_age_days": T.LongType(),
    "day_of_week": T.IntegerType(),
    "merchant_category": T.StringType(),
    "card_type": T.StringType(),
    "distinct_merchant_count_1hour": T.LongType(),
}
# Training files carry category names; quality issues may blank any number, so all are nullable
# and whole-number columns are read as doubles.
TRAINING_SCHEMA = T.StructType(
    [T.StructField("transaction_id", T.StringType()), T.StructField("user_id", T.StringType())]
    + [
        T.StructField(
            name,
            _FEATURE_TYPES[name]
            if name in _FEATURE_TYPES and not isinstance(_FEATURE_TYPES[name], (T.LongType, T.IntegerType))
            else T.DoubleType(),
        )
        for name in BASE_FEATURES
    ]
    + [T.StructField("is_fraud", T.BooleanType())]
)
CONTRIBUTION_TYPE = T.StructType([
    T.StructField("feature_name", T.StringType()),
    T.StructField("feature_value", T.DoubleType()),
    T.StructField("contribution", T.DoubleType()),
    T.StructField("direction", T.StringType()),
])
