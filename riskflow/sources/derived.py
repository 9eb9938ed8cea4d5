"""Transaction tables derived from the star-schema test tables.

One SQL text per table serves both engines: Spark runs it over the parquet scans, the check engine
inlines it as a CTE. Only the timestamp literal differs. Ids are padded to twelve digits so that
they stay unique at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskflow.schemas import CARD_TYPES, COUNTRIES, DEVICE_TYPES, MERCHANT_CATEGORIES

_CODES = "".join(COUNTRIES)


def _pick(expr: str, names: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {expr} {arms} END"


def _id(prefix: str, expr: str) -> str:
    return f"'{prefix}-' || lpad(CAST({expr} AS VARCHAR(20)), 12, '0')"


def _country(expr: str) -> str:
    return f"substr('{_CODES}', CAST(2 * ({expr}) + 1 AS INTEGER), 2)"


_DAY0 = "@TS '2024-01-01 00:00:00'"

TABLE_SQL: dict[str, str] = {
    "users": f"""
        SELECT {_id('user', 'c_custkey')} AS user_id, {_country('c_nationkey % 20')} AS home_country_code,
          {_DAY0} - (c_custkey * 37 % 540) * INTERVAL '1' DAY - (c_custkey % 24) * INTERVAL '1' HOUR
            AS creation_date_time
        FROM customer""",
    "cards": f"""
        SELECT {_id('card', 'c_custkey')} AS card_id, {_pick('c_custkey % 4', CARD_TYPES)} AS type,
          {_DAY0} - (c_custkey * 53 % 540) * INTERVAL '1' DAY - (c_custkey % 7) * INTERVAL '1' HOUR
            AS creation_date_time
        FROM customer""",
    "merchants": f"""
        SELECT {_id('merchant', 's_suppkey')} AS merchant_id,
          CAST((5 + s_suppkey * 17 % 86) AS DOUBLE) / 100 AS risk_score,
          {_pick('s_suppkey % 8', MERCHANT_CATEGORIES)} AS category
        FROM supplier""",
    "devices": f"""
        SELECT DISTINCT {_id('device', 'event_id % 50')} AS device_id,
          {_pick('event_id % 5', DEVICE_TYPES)} AS type
        FROM events WHERE event_id % 50 < 40""",
    "transactions": f"""
        SELECT {_id('tx', 'e.event_id')} AS transaction_id, {_id('user', 'e.user_id')} AS user_id,
          {_id('card', 'e.user_id')} AS card_id,
          {_id('merchant', '(e.event_id * 31 + e.user_id) % 10')} AS merchant_id,
          CASE WHEN e.event_id % 10 < 7 THEN {_id('device', 'e.event_id % 50')} END AS device_id,
          CAST(e.value AS DECIMAL(19,2)) AS amount,
          {_country('CASE WHEN e.event_id % 7 = 0 THEN (c.c_nationkey + 1 + e.event_id % 19) % 20 ELSE c.c_nationkey % 20 END')}
            AS country_code,
          CASE WHEN e.event_id % 13 = 0 THEN NULL
               ELSE '203.0.113.' || regexp_extract(e.props, '[0-9]+', 0) END AS ip_address,
          e.ts AS creation_date_time, e.event_type = 'error' AS is_fraud
        FROM events e JOIN customer c ON c.c_custkey = e.user_id""",
    # The same stream as it arrives: some fields missing, some out of range.
    "raw_transactions": f"""
        SELECT event_id, CASE event_id % 29 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE {_id('tx', 'event_id')} END AS transaction_id,
          CASE WHEN event_id % 31 = 0 THEN '' ELSE {_id('user', 'user_id')} END AS user_id,
          CASE WHEN event_id % 37 = 0 THEN NULL ELSE {_id('card', 'user_id')} END AS card_id,
          CASE WHEN event_id % 41 = 0 THEN '  ' ELSE {_id('merchant', '(event_id * 31 + user_id) % 10')} END AS merchant_id,
          CASE WHEN event_id % 10 < 7 THEN {_id('device', 'event_id % 50')} END AS device_id,
          CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 47 = 0 THEN -CAST(value AS DECIMAL(19,2))
               WHEN event_id % 53 = 0 THEN CAST(0 AS DECIMAL(19,2)) ELSE CAST(value AS DECIMAL(19,2)) END AS amount,
          CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 61 = 0 THEN 'XX' ELSE {_country('event_id % 20')} END AS country_code,
          CASE WHEN event_id % 13 = 0 THEN NULL
               ELSE '203.0.113.' || regexp_extract(props, '[0-9]+', 0) END AS ip_address,
          CASE WHEN event_id % 67 = 0 THEN NULL ELSE ts END AS creation_date_time
        FROM events""",
    "predictions": f"""
        SELECT transaction_id, prob AS fraud_probability,
          CASE WHEN prob > 0.70 THEN 'HIGH' WHEN prob > 0.30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
          CASE WHEN event_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version, prob < 0.70 AS is_marked_as_safe
        FROM (SELECT event_id, {_id('tx', 'event_id')} AS transaction_id,
                CAST(event_id * 7919 % 10000 AS DOUBLE) / 10000 AS prob FROM events) p""",
    "eval_scores": f"""
        SELECT {_id('tx', 'event_id')} AS transaction_id, event_type = 'error' AS is_fraud,
          CAST(event_id * 7919 % 100 + CASE WHEN event_type = 'error' THEN 50 ELSE 0 END AS DOUBLE) / 150 AS score
        FROM events""",
    # One release object per supplier; a seventh of the names lack the model prefix.
    "model_releases": """
        SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'draft_' ELSE 'lgbm_' END || 'v' || CAST(s_suppkey AS VARCHAR(20)) AS object_name,
          @TS '2023-12-20 00:00:00' + (s_suppkey * 7919 % 3600000) * INTERVAL '1' SECOND AS released_at
        FROM supplier""",
    "tasks": f"""
        SELECT {_id('tx', 'event_id')} AS transaction_id,
          CASE event_id % 4 WHEN 0 THEN 'PENDING_LLM' WHEN 1 THEN 'PENDING_EMAIL' WHEN 2 THEN 'COMPLETED' ELSE 'DEAD_LETTER' END AS status,
          CAST(event_id % 5 AS INTEGER) AS attempts, ts + (event_id % 90) * INTERVAL '1' SECOND AS next_retry_at
        FROM events WHERE event_id * 7919 % 10000 > 7000 AND event_id % 3 <> 0""",
    "outcomes": f"""
        SELECT {_id('tx', 'event_id')} AS transaction_id, event_id % 7 <> 0 AS llm_ok, event_id % 5 <> 0 AS email_ok
        FROM events""",
    # Scoring durations in seconds, for the latency histograms.
    "durations": """
        SELECT ts, CAST(event_id * 7919 % 3000 AS DOUBLE) / 1000 AS seconds FROM events""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table of the given directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, planned lazily over the base scans."""
    sql = TABLE_SQL[name].replace("@TS", "TIMESTAMP_NTZ")
    bases = [b for b in ("customer", "supplier", "events") if f" {b}" in sql]
    for base in bases:
        sql = sql.replace(f"FROM {base}", "FROM {" + base + "}").replace(f"JOIN {base}", "JOIN {" + base + "}")
    return spark.sql(sql, **{b: table(spark, sf_dir, b) for b in bases})


def ctes(*names: str) -> str:
    """WITH clause (without the keyword) inlining derived tables for the check engine."""
    return ",\n".join(f"{n} AS ({TABLE_SQL[n].replace('@TS', 'TIMESTAMP')})" for n in names)
