"""Joins, history, windows and scalar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow import schemas as S
from riskflow.catalog.inputs import (
    dimensions, feature_table, predictions, rounded, transaction_table, transactions,
)
from riskflow.catalog.registry import query
from riskflow.functions.scalar import epoch_seconds
from riskflow.operators import enrich, history, registry, validate
from riskflow.operators.evaluate import pr_curve
from riskflow.operators.outbox import without_queued
from riskflow.operators.velocity import recent_entries, velocity_features
from riskflow.plans.feature_vector import feature_vector
from riskflow.sources.derived import derived

_DOUBLES = {
    "amount", "user_average_amount", "amount_velocity_1hour", "merchant_risk_score", "amount_to_average_ratio",
    "ip_risk_score", *S.ENGINEERED_FEATURES,
} - {"is_night"}


# A product of two fractions can end in a five at the seventh digit, where engines round apart.
_DIGITS = {"risk_score_product": 12}


def _shown(names: list[str]) -> str:
    return ", ".join(
        f"round(CAST({n} AS DOUBLE), {_DIGITS.get(n, 6)}) AS {n}" if n in _DOUBLES else n for n in names)


# ---- C: joins ----
@query("c1_enrich_user", "SELECT transaction_id, home_country_code, user_created_at FROM enriched", ("enriched",))
def c1(spark, sf):
    return enrich.with_user(transactions(spark, sf), derived(spark, sf, "users")).select(
        "transaction_id", "home_country_code", "user_created_at")


@query("c2_enrich_merchant", "SELECT transaction_id, merchant_risk_score, merchant_category FROM enriched", ("enriched",))
def c2(spark, sf):
    return enrich.with_merchant(transactions(spark, sf), derived(spark, sf, "merchants")).select(
        "transaction_id", "merchant_risk_score", "merchant_category")


@query("c3_enrich_card", "SELECT transaction_id, card_type, card_created_at FROM enriched", ("enriched",))
def c3(spark, sf):
    return enrich.with_card(transactions(spark, sf), derived(spark, sf, "cards")).select(
        "transaction_id", "card_type", "card_created_at")


@query("c4_device_trusted", "SELECT transaction_id, is_device_trusted FROM enriched", ("enriched",))
def c4(spark, sf):
    return enrich.with_device_trust(transactions(spark, sf), derived(spark, sf, "devices")).select(
        "transaction_id", "is_device_trusted")


@query("e1_rows_without_keys", """
    SELECT count(*) AS rows, count(*) FILTER (WHERE user_id IS NOT NULL AND merchant_id IS NOT NULL AND creation_date_time IS NOT NULL) AS windowed
    FROM raw_transactions""", ("raw_transactions",))
def e1_rows_without_keys(spark, sf):
    """Windows over incomplete rows: each comes back once, those without time unwindowed."""
    found = velocity_features(derived(spark, sf, "raw_transactions").drop("transaction_id").withColumnRenamed("event_id", "transaction_id"))
    return found.agg(F.count("*").alias("rows"), F.count("user_transaction_count_1hour").alias("windowed"))


@query("e6_rows_without_keys", """
    , r AS (SELECT event_id, user_id, amount, epoch_us(creation_date_time) // 1000000 AS sec FROM raw_transactions),
    h AS (
      SELECT event_id, lag(event_id) OVER o AS previous_transaction_id, count(*) OVER w AS user_historical_transaction_count,
        CASE WHEN sum(amount) OVER w > 0 THEN CAST(sum(amount) OVER w AS DOUBLE) / count(*) OVER w ELSE 100.0 END AS user_average_amount
      FROM r WHERE trim(coalesce(user_id, '')) <> '' AND sec IS NOT NULL
      WINDOW o AS (PARTITION BY user_id ORDER BY sec, event_id), w AS (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT r.event_id AS transaction_id, round(user_average_amount, 6) AS user_average_amount, user_historical_transaction_count, previous_transaction_id
    FROM r LEFT JOIN h USING (event_id)""", ("raw_transactions",))
def e6_rows_without_keys(spark, sf):
    """Histories over incomplete rows: one without user or time has none, and is in none."""
    rows = derived(spark, sf, "raw_transactions").drop("transaction_id").withColumnRenamed("event_id", "transaction_id")
    return rounded(history.user_history(rows, None).join(history.previous_transaction(rows).drop("seconds_since_previous"), "transaction_id"))


@query("c5_missing_reference", """
    SELECT t.transaction_id, CASE WHEN u.user_id IS NULL THEN 'user' WHEN m.merchant_id IS NULL THEN 'merchant'
      WHEN c.card_id IS NULL THEN 'card' WHEN t.device_id IS NOT NULL AND d.device_id IS NULL THEN 'device' END AS missing_reference
    FROM transactions t LEFT JOIN users u USING (user_id) LEFT JOIN merchants m USING (merchant_id) LEFT JOIN cards c USING (card_id)
      LEFT JOIN devices d USING (device_id)""", ("transactions", "users", "merchants", "cards", "devices"))
def c5(spark, sf):
    d = dimensions(spark, sf)
    return validate.check_references(transactions(spark, sf), d.users, d.merchants, d.cards, d.devices).select("transaction_id", "missing_reference")


@query("c6_left_join_prediction", """
    SELECT transaction_id, CAST(amount AS DOUBLE) AS amount, risk_level, is_marked_as_safe
    FROM transactions LEFT JOIN predictions p USING (transaction_id)""",
       ("transactions", "predictions"))
def c6(spark, sf):
    return rounded(history.with_predictions(transactions(spark, sf), predictions(spark, sf)).select(
        "transaction_id", "amount", "risk_level", "is_marked_as_safe"))


@query("c7_transaction_vector_prediction", """
    SELECT f.transaction_id, f.user_id, hour_of_day, day_of_week, user_historical_transaction_count, risk_level, model_version
    FROM base_features f JOIN predictions USING (transaction_id)""", ("base_features", "predictions"))
def c7(spark, sf):
    return history.scored_transactions(
        transactions(spark, sf), feature_table(spark, sf).select("transaction_id", *S.FEATURES), predictions(spark, sf)).select(
        "transaction_id", "user_id", "hour_of_day", "day_of_week", "user_historical_transaction_count", "risk_level", "model_version")


@query("c8_not_queued", "SELECT transaction_id, risk_level FROM predictions WHERE transaction_id NOT IN (SELECT transaction_id FROM tasks)",
       ("predictions", "tasks"))
def c8(spark, sf):
    return without_queued(predictions(spark, sf), derived(spark, sf, "tasks")).select("transaction_id", "risk_level")


_C9 = """
    SELECT t.transaction_id, r.object_name AS model_version
    FROM transactions t ASOF LEFT JOIN (SELECT * FROM model_releases WHERE starts_with(object_name, 'lgbm_')) r
      ON t.creation_date_time >= r.released_at"""


@query("c9_model_in_force", _C9, ("transactions", "model_releases"))
def c9(spark, sf):
    return registry.model_in_force(transactions(spark, sf), derived(spark, sf, "model_releases")).select(
        "transaction_id", "model_version")


@query("c9_model_in_force_large_registry", _C9, ("transactions", "model_releases"))
def c9_large(spark, sf):
    return registry.model_in_force(
        transactions(spark, sf), derived(spark, sf, "model_releases"), small_registry=0).select("transaction_id", "model_version")


@query("c10_previous_transaction", """
    SELECT transaction_id, lag(transaction_id) OVER w AS previous_transaction_id, sec - lag(sec) OVER w AS seconds_since_previous
    FROM rows_ WINDOW w AS (PARTITION BY user_id ORDER BY sec, transaction_id)""", ("rows_",))
def c10(spark, sf):
    return history.previous_transaction(transactions(spark, sf))


@query("c11_country_mismatch", "SELECT transaction_id, has_country_mismatch FROM enriched", ("enriched",))
def c11(spark, sf):
    return enrich.with_country_mismatch(enrich.with_user(transactions(spark, sf), derived(spark, sf, "users"))).select(
        "transaction_id", "has_country_mismatch")


# ---- D1-D3: whole-table history ----
@query("d1_user_average_amount", """
    SELECT user_id, coalesce(round(CAST(sum(amount) FILTER (WHERE is_marked_as_safe) AS DOUBLE) / nullif(count(*) FILTER (WHERE is_marked_as_safe), 0), 6), 0.0) AS average_amount
    FROM scored GROUP BY user_id""", ("scored",))
def d1(spark, sf):
    return rounded(history.user_averages(transactions(spark, sf), predictions(spark, sf)))


@query("d2_user_transaction_count", "SELECT user_id, count(*) AS transaction_count FROM transactions GROUP BY user_id", ("transactions",))
def d2(spark, sf):
    return history.user_counts(transactions(spark, sf))


@query("d3_ip_risk", """
    SELECT ip_address, round(sum(CASE risk_level WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.5 ELSE 0.0 END) / count(*), 6) AS ip_risk_score
    FROM scored WHERE ip_address IS NOT NULL GROUP BY ip_address""", ("scored",))
def d3(spark, sf):
    return rounded(history.ip_risk(transactions(spark, sf), predictions(spark, sf)))


# ---- E: windows ----
def _velocity_query(name: str, column: str, block: str):
    shown = f"round({column}, 2) AS {column}" if column.startswith("amount") else column

    @query(name, f"SELECT transaction_id, {shown} FROM {block}", (block,))
    def run(spark, sf, column=column):
        return rounded(velocity_features(transaction_table(spark, sf)).select("transaction_id", column), 2)


_velocity_query("e1_user_count_5min", "user_transaction_count_5min", "velocity")
_velocity_query("e2_user_count_1hour", "user_transaction_count_1hour", "velocity")
_velocity_query("e3_amount_velocity_1hour", "amount_velocity_1hour", "velocity")
_velocity_query("e4_distinct_merchants_1hour", "distinct_merchant_count_1hour", "velocity")
_velocity_query("e5_seconds_since_last", "seconds_since_last_transaction", "recency")


@query("e6_user_average_so_far", "SELECT transaction_id, round(user_average_amount, 6) AS user_average_amount FROM history", ("history",))
def e6(spark, sf):
    return rounded(history.user_history(transactions(spark, sf), None).select("transaction_id", "user_average_amount"))


@query("e6_safe_average_so_far", "SELECT transaction_id, round(user_average_amount, 6) AS user_average_amount FROM safe_history", ("safe_history",))
def e6_safe(spark, sf):
    return rounded(history.user_history(transactions(spark, sf), predictions(spark, sf), safe_only=True).select(
        "transaction_id", "user_average_amount"))


@query("e7_user_count_so_far", "SELECT transaction_id, user_historical_transaction_count FROM history", ("history",))
def e7(spark, sf):
    return history.user_history(transactions(spark, sf), None).select("transaction_id", "user_historical_transaction_count")


@query("e8_ip_risk_so_far", "SELECT transaction_id, round(ip_risk_score, 6) AS ip_risk_score FROM address", ("address",))
def e8(spark, sf):
    return rounded(history.ip_history(transactions(spark, sf), predictions(spark, sf)))


@query("e8_ip_risk_so_far_split_groups", "SELECT transaction_id, round(ip_risk_score, 6) AS ip_risk_score FROM address", ("address",))
def e8_split(spark, sf):
    """The same with every address above 50 rows treated as large."""
    return rounded(history.ip_history(transactions(spark, sf), predictions(spark, sf), max_group_rows=50))


@query("e9_session_windows", """
    SELECT transaction_id, user_transaction_count_5min, user_transaction_count_1hour, round(amount_velocity_1hour, 2) AS amount_velocity_1hour,
      distinct_merchant_count_1hour, seconds_since_last_transaction FROM ttl_velocity""", ("ttl_velocity",))
def e9(spark, sf):
    return rounded(velocity_features(transaction_table(spark, sf), ttl_seconds=S.SESSION_TTL_SECONDS), 2)


@query("e10_recent_entries", """
    SELECT user_id, count(*) AS kept FROM rows_ WHERE sec > epoch_us(TIMESTAMP '2024-01-20 00:00:00') // 1000000 - 3600 GROUP BY user_id""", ("rows_",))
def e10(spark, sf):
    now = 1_705_708_800  # 2024-01-20 00:00:00
    return recent_entries(transactions(spark, sf), now).groupBy("user_id").agg(F.count("*").alias("kept"))


@query("e11_running_precision_recall", "SELECT round(threshold, 6) AS threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve", ("curve",))
def e11(spark, sf):
    return rounded(pr_curve(derived(spark, sf, "eval_scores"), "score", "is_fraud", max_group_rows=40)
                   .select("threshold", "tp", "fp", "precision", "recall"))


# ---- F: scalar features, each as its column of the feature table ----
_F_IDS = {
    "f1": "amount_to_average_ratio", "f2": "hour_of_day", "f3": "day_of_week", "f4": "card_age_days",
    "f5": "user_account_age_days", "f6": "log_amount", "f7": "log_seconds_since", "f8": "log_velocity_1hour",
    "f9": "amount_x_merchant_risk", "f10": "risk_score_product", "f11": "ip_device_risk", "f12": "country_ip_risk",
    "f13": "velocity_amount_interaction", "f14": "recency_velocity", "f15": "amount_deviation", "f16": "is_night",
    "f17": "velocity_intensity", "f18": "is_device_trusted", "f19": "has_country_mismatch",
}
for _id, _name in _F_IDS.items():

    @query(f"{_id}_{_name}", f"SELECT transaction_id, {_shown([_name])} FROM features", ("features",))
    def _feature(spark, sf, name=_name):
        return rounded(feature_table(spark, sf).select("transaction_id", name), digits=_DIGITS)


@query("f20_feature_vector", f"SELECT transaction_id, {_shown(S.FEATURES)} FROM features", ("features",))
def f20(spark, sf):
    return rounded(feature_vector(transaction_table(spark, sf), dimensions(spark, sf), predictions(spark, sf)), digits=_DIGITS)


@query("f20_serving_feature_vector", """
    SELECT b.transaction_id, round(s.user_average_amount, 6) AS user_average_amount, t.user_transaction_count_5min,
      t.user_transaction_count_1hour, round(t.amount_velocity_1hour, 2) AS amount_velocity_1hour, t.distinct_merchant_count_1hour,
      t.seconds_since_last_transaction
    FROM rows_ b JOIN safe_history s USING (transaction_id) JOIN ttl_velocity t USING (transaction_id)""",
       ("rows_", "safe_history", "ttl_velocity"))
def f20_serving(spark, sf):
    """Serving mode: windows end after ten idle minutes, averages take safe rows only."""
    df = feature_vector(transaction_table(spark, sf), dimensions(spark, sf), predictions(spark, sf),
                        ttl_seconds=S.SESSION_TTL_SECONDS, safe_only=True)
    return rounded(df.select(
        "transaction_id", "user_average_amount", "user_transaction_count_5min", "user_transaction_count_1hour",
        "amount_velocity_1hour", "distinct_merchant_count_1hour", "seconds_since_last_transaction"))


@query("b15_epoch_seconds", """
    SELECT transaction_id, CASE WHEN stamp > 10000000000 THEN stamp // 1000 ELSE stamp END AS seconds
    FROM (SELECT transaction_id, CASE WHEN is_fraud THEN epoch_us(creation_date_time) // 1000 ELSE sec END AS stamp FROM rows_) s""", ("rows_",))
def b15(spark, sf):
    from riskflow.functions.scalar import normalize_epoch

    ts = F.col("creation_date_time")
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', creation_date_time)")
    stamp = F.when(F.col("is_fraud"), ms).otherwise(epoch_seconds(ts))
    return transactions(spark, sf).select("transaction_id", normalize_epoch(stamp).alias("seconds"))
