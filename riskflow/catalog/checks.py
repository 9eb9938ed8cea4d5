"""SQL building blocks of the check engine: each states one operator directly, over whole tables."""

from __future__ import annotations

from riskflow.sources.derived import TABLE_SQL

_ORDER = "ORDER BY sec, transaction_id"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _velocity(rows: str, extra: str = "") -> str:
    return f"""
        SELECT a.transaction_id,
          count(b.sec) FILTER (WHERE b.sec >= a.sec - 300) AS user_transaction_count_5min,
          count(b.sec) AS user_transaction_count_1hour,
          CAST(coalesce(sum(b.amount), 0) AS DOUBLE) AS amount_velocity_1hour,
          count(DISTINCT b.merchant_id) AS distinct_merchant_count_1hour
        FROM {rows} a LEFT JOIN {rows} b ON a.user_id = b.user_id {extra}
          AND b.sec BETWEEN a.sec - 3600 AND a.sec AND (b.sec < a.sec OR b.transaction_id < a.transaction_id)
        GROUP BY a.transaction_id"""


_BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    **{name: ((), sql.replace("@TS", "TIMESTAMP")) for name, sql in TABLE_SQL.items()},
    "rows_": (("transactions",), "SELECT *, epoch_us(creation_date_time) // 1000000 AS sec FROM transactions"),
    "velocity": (("rows_",), _velocity("rows_")),
    "recency": (("rows_",), f"""
        SELECT transaction_id, coalesce(sec - lag(sec) OVER (PARTITION BY user_id {_ORDER}), 2592000) AS seconds_since_last_transaction
        FROM rows_"""),
    "gaps": (("rows_",), f"SELECT *, sec - lag(sec) OVER (PARTITION BY user_id {_ORDER}) AS gap FROM rows_"),
    "sessions": (("gaps",), f"""
        SELECT *, sum(CASE WHEN gap >= 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id {_ORDER}) AS session_no FROM gaps"""),
    "ttl_velocity": (("sessions",), f"""
        SELECT v.*, CASE WHEN s.gap < 600 THEN s.gap ELSE 2592000 END AS seconds_since_last_transaction
        FROM ({_velocity('sessions', 'AND a.session_no = b.session_no')}) v JOIN sessions s USING (transaction_id)"""),
    "history": (("rows_",), f"""
        SELECT transaction_id,
          CASE WHEN sum(amount) OVER w > 0 THEN CAST(sum(amount) OVER w AS DOUBLE) / count(*) OVER w ELSE 100.0 END AS user_average_amount,
          count(*) OVER w AS user_historical_transaction_count
        FROM rows_ WINDOW w AS (PARTITION BY user_id {_ORDER} {_BEFORE})"""),
    "safe_history": (("rows_", "predictions"), f"""
        SELECT transaction_id,
          CASE WHEN sum(amount) FILTER (WHERE is_marked_as_safe) OVER w > 0
               THEN CAST(sum(amount) FILTER (WHERE is_marked_as_safe) OVER w AS DOUBLE) / count(*) FILTER (WHERE is_marked_as_safe) OVER w
               ELSE 100.0 END AS user_average_amount,
          count(*) OVER w AS user_historical_transaction_count
        FROM rows_ LEFT JOIN predictions USING (transaction_id) WINDOW w AS (PARTITION BY user_id {_ORDER} {_BEFORE})"""),
    "address": (("rows_", "predictions"), f"""
        SELECT transaction_id, coalesce(avg(CASE risk_level WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.5 ELSE 0.0 END) OVER w, 0.0) AS ip_risk_score
        FROM rows_ LEFT JOIN predictions USING (transaction_id) WHERE trim(coalesce(ip_address, '')) <> ''
        WINDOW w AS (PARTITION BY ip_address {_ORDER} {_BEFORE})"""),
    "enriched": (("transactions", "users", "merchants", "cards", "devices"), """
        SELECT t.*, u.home_country_code, u.creation_date_time AS user_created_at, m.risk_score AS merchant_risk_score,
          CASE m.category WHEN 'GROCERY' THEN 0 WHEN 'RESTAURANT' THEN 1 WHEN 'ENTERTAINMENT' THEN 2 WHEN 'TRAVEL' THEN 3
            WHEN 'HEALTHCARE' THEN 4 WHEN 'EDUCATION' THEN 5 WHEN 'UTILITIES' THEN 6 ELSE 7 END AS merchant_category,
          CASE c.type WHEN 'CREDIT' THEN 0 WHEN 'DEBIT' THEN 1 WHEN 'CREDIT_AND_DEBIT' THEN 2 ELSE 3 END AS card_type,
          c.creation_date_time AS card_created_at, d.device_id IS NOT NULL AS is_device_trusted,
          u.home_country_code <> t.country_code AS has_country_mismatch
        FROM transactions t LEFT JOIN users u ON u.user_id = t.user_id LEFT JOIN merchants m ON m.merchant_id = t.merchant_id
          LEFT JOIN cards c ON c.card_id = t.card_id LEFT JOIN devices d ON d.device_id = t.device_id"""),
    "base_features": (("enriched", "velocity", "recency", "history", "address"), """
        SELECT e.*, v.* EXCLUDE (transaction_id), r.seconds_since_last_transaction, h.* EXCLUDE (transaction_id),
          coalesce(a.ip_risk_score, 0.0) AS ip_risk_score,
          round(CAST(e.amount AS DOUBLE) / greatest(h.user_average_amount, 1.0), 4) AS amount_to_average_ratio,
          hour(e.creation_date_time) AS hour_of_day, isodow(e.creation_date_time) AS day_of_week,
          CAST(floor((epoch_us(e.creation_date_time) // 1000000 - epoch_us(e.card_created_at) // 1000000) / 86400) AS BIGINT) AS card_age_days,
          CAST(floor((epoch_us(e.creation_date_time) // 1000000 - epoch_us(e.user_created_at) // 1000000) / 86400) AS BIGINT) AS user_account_age_days
        FROM enriched e JOIN velocity v USING (transaction_id) JOIN recency r USING (transaction_id)
          JOIN history h USING (transaction_id) LEFT JOIN address a USING (transaction_id)"""),
    "features": (("base_features",), """
        SELECT *, ln(1 + CAST(amount AS DOUBLE)) AS log_amount, ln(1 + seconds_since_last_transaction) AS log_seconds_since,
          ln(1 + amount_velocity_1hour) AS log_velocity_1hour, CAST(amount AS DOUBLE) * merchant_risk_score AS amount_x_merchant_risk,
          merchant_risk_score * ip_risk_score AS risk_score_product,
          CASE WHEN is_device_trusted THEN 0.0 ELSE ip_risk_score END AS ip_device_risk,
          CASE WHEN has_country_mismatch THEN ip_risk_score ELSE 0.0 END AS country_ip_risk,
          user_transaction_count_1hour * amount_to_average_ratio AS velocity_amount_interaction,
          CAST(user_transaction_count_5min AS DOUBLE) / greatest(seconds_since_last_transaction, 1) AS recency_velocity,
          abs(CAST(amount AS DOUBLE) - user_average_amount) / greatest(user_average_amount, 1.0) AS amount_deviation,
          hour_of_day < 6 OR hour_of_day >= 22 AS is_night,
          amount_velocity_1hour / greatest(user_transaction_count_1hour, 1) AS velocity_intensity
        FROM base_features"""),
    "scored": (("transactions", "predictions"), "SELECT * FROM transactions JOIN predictions USING (transaction_id)"),
    "curve": (("eval_scores",), """
        SELECT score AS threshold, CAST(sum(pos) OVER d AS BIGINT) AS tp, CAST(sum(neg) OVER d AS BIGINT) AS fp,
          sum(pos) OVER d / (sum(pos) OVER d + sum(neg) OVER d) AS precision, sum(pos) OVER d / sum(pos) OVER () AS recall,
          pos / sum(pos) OVER () AS gain
        FROM (SELECT score, count(*) FILTER (WHERE is_fraud) AS pos, count(*) FILTER (WHERE NOT is_fraud) AS neg
              FROM eval_scores GROUP BY score) s
        WINDOW d AS (ORDER BY score DESC)"""),
}

_RULES = [
    ("userId", "must not be blank", "trim(coalesce(user_id, '')) = ''"),
    ("cardId", "must not be blank", "trim(coalesce(card_id, '')) = ''"),
    ("merchantId", "must not be blank", "trim(coalesce(merchant_id, '')) = ''"),
    ("amount", "must not be null", "amount IS NULL"),
    ("amount", "must be greater than 0", "amount <= 0"),
    ("countryCode", "must not be null", "country_code IS NULL"),
    ("countryCode", "must be a known country code",
     "country_code NOT IN ('AR','AU','BR','CA','CH','CL','CN','DE','ES','FR','GB','IN','IT','JP','MX','NL','PT','SE','US','ZA')"),
    ("creationDateTime", "must not be null", "creation_date_time IS NULL"),
    ("creationDateTime", "must be a date in the past or in the present", "creation_date_time > TIMESTAMP '2024-01-28 00:00:00'"),
]
_BLOCKS["violations"] = (("raw_transactions",), "SELECT *, concat_ws(' ', " + ", ".join(
    f"CASE WHEN {rule} THEN '[{field}: {message}]' END" for field, message, rule in _RULES) + ") AS problems FROM raw_transactions")


def add_block(name: str, needs: tuple[str, ...], sql: str) -> None:
    _BLOCKS[name] = (needs, sql)


def with_clause(*names: str) -> str:
    """WITH clause holding the named blocks and everything they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _BLOCKS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({_BLOCKS[n][1]})" for n in ordered) + "\n"
