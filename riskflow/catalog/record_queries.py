"""Scans, sinks, validation and record shaping."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskflow import schemas as S
from riskflow.catalog.inputs import (
    feature_table, once, predictions, rounded, scored, training_set, transactions,
)
from riskflow.catalog.registry import query
from riskflow.functions import scalar
from riskflow.operators import alerts, explain, messages, outbox, registry, validate
from riskflow.plans.feature_vector import numeric_features
from riskflow.sources import files
from riskflow.sources.derived import derived


def _now():
    return F.expr("timestamp_ntz'2024-01-28 00:00:00'")


def _status_now():
    return F.expr("timestamp_ntz'2024-01-15 00:00:00'")


# ---- A: scans and sinks ----
_SCANS = {
    "users": ("user_id", "home_country_code", "creation_date_time"),
    "merchants": ("merchant_id", "risk_score", "category"),
    "cards": ("card_id", "type", "creation_date_time"),
    "devices": ("device_id", "type"),
    "transactions": ("transaction_id", "user_id", "card_id", "merchant_id", "device_id", "country_code", "ip_address", "creation_date_time"),
    "predictions": ("transaction_id", "fraud_probability", "risk_level", "model_version", "is_marked_as_safe"),
}
for _table, _columns in _SCANS.items():

    @query(f"a4_scan_{_table}", f"SELECT {', '.join(_columns)} FROM {_table}", (_table,))
    def _scan(spark, sf, table=_table, columns=_columns):
        return derived(spark, sf, table).select(*columns)


def _training_csv(spark, sf):
    return once(spark, sf, "training_csv", lambda path: files.write_training_csv(training_set(spark, sf), path))


@query("a2_training_csv", """
    SELECT transaction_id, user_id, round(CAST(amount AS DOUBLE), 6) AS amount, round(user_average_amount, 6) AS user_average_amount,
      CAST(user_historical_transaction_count AS DOUBLE) AS user_historical_transaction_count, is_device_trusted,
      round(ip_risk_score, 6) AS ip_risk_score, category AS merchant_category, is_fraud
    FROM base_features JOIN merchants USING (merchant_id)""", ("base_features", "merchants"))
def a2(spark, sf):
    return rounded(files.read_training_csv(spark, _training_csv(spark, sf)).select(
        "transaction_id", "user_id", "amount", "user_average_amount", "user_historical_transaction_count",
        "is_device_trusted", "ip_risk_score", "merchant_category", "is_fraud"))


@query("a3_training_csv_lines", "SELECT user_id, count(*) AS n FROM transactions GROUP BY user_id", ("transactions",))
def a3(spark, sf):
    """Lines of the written files, read back as text: header lines aside, one per transaction."""
    lines = spark.read.text(_training_csv(spark, sf)).filter(~F.startswith("value", F.lit("transaction_id,")))
    return lines.groupBy(F.split_part("value", F.lit(","), F.lit(2)).alias("user_id")).agg(F.count("*").alias("n"))


@query("a5_scored_records", """
    SELECT transaction_id AS key, user_id, risk_level, hour_of_day FROM base_features JOIN predictions USING (transaction_id)""",
       ("base_features", "predictions"))
def a5(spark, sf):
    records = messages.scored_records(feature_table(spark, sf).join(predictions(spark, sf), "transaction_id"))
    at = lambda path: F.get_json_object("value", path)
    return records.select(
        "key", at("$.userId").alias("user_id"), at("$.predictionMessage.riskLevel").alias("risk_level"),
        at("$.featuresMessage.hourOfDay").cast("int").alias("hour_of_day"))


@query("a7_dead_letters_by_topic", "SELECT 'transactions.created' AS topic, count(*) AS dead_letters FROM violations WHERE problems <> ''", ("violations",))
def a7(spark, sf):
    checked = validate.validate_transactions(derived(spark, sf, "raw_transactions").drop("event_id"), _now())
    return validate.dead_letter_counts(validate.dead_letters(validate.split_valid(checked)[1], "transactions.created"))


def _json_lines(spark, sf):
    """Created-transaction messages, one in twenty cut short."""
    value = messages.created_value()
    cut = F.expr("CAST(substr(transaction_id, 4) AS BIGINT) % 20 = 0")
    return transactions(spark, sf).withColumn("_v", value).select(
        F.when(cut, F.substring("_v", 1, 40)).otherwise(F.col("_v")).alias("value"))


@query("a8_readable_messages", """
    SELECT transaction_id, user_id, CAST(amount AS DOUBLE) AS amount, country_code FROM transactions
    WHERE CAST(substr(transaction_id, 4) AS BIGINT) % 20 <> 0""", ("transactions",))
def a8(spark, sf):
    return rounded(messages.parse_created(_json_lines(spark, sf))[0].select("transaction_id", "user_id", "amount", "country_code"))


@query("a8_corrupt_messages", "SELECT count(*) AS corrupt FROM transactions WHERE CAST(substr(transaction_id, 4) AS BIGINT) % 20 = 0", ("transactions",))
def a8_bad(spark, sf):
    return messages.parse_created(_json_lines(spark, sf))[1].agg(F.count("*").alias("corrupt"))


@query("a9_release_events", """
    SELECT object_name, 'models' AS bucket, epoch_us(released_at) // 1000000 AS "timestamp" FROM model_releases""", ("model_releases",))
def a9(spark, sf):
    return registry.release_events(derived(spark, sf, "model_releases"))


@query("a10_insert_if_absent", "SELECT transaction_id, risk_level, model_version FROM predictions WHERE model_version = 'v2'", ("predictions",))
def a10(spark, sf):
    p = predictions(spark, sf)
    return validate.insert_if_absent(p.filter("model_version = 'v1'"), p, "transaction_id").select(
        "transaction_id", "risk_level", "model_version")


# ---- B: validation and shaping ----
@query("b1_default_ids", """
    SELECT count(*) AS n, count(*) AS with_id, count(DISTINCT CASE WHEN trim(coalesce(transaction_id, '')) = '' THEN CAST(event_id AS VARCHAR) ELSE transaction_id END) AS distinct_ids
    FROM raw_transactions""", ("raw_transactions",))
def b1(spark, sf):
    df = validate.default_transaction_id(derived(spark, sf, "raw_transactions"))
    return df.agg(F.count("*").alias("n"), F.count_if(~scalar.is_blank(F.col("transaction_id"))).alias("with_id"),
                  F.countDistinct("transaction_id").alias("distinct_ids"))


def _checked(spark, sf):
    return validate.validate_transactions(derived(spark, sf, "raw_transactions"), _now())


@query("b2_violations", "SELECT event_id, problems FROM violations", ("violations",))
def b2(spark, sf):
    one = F.transform("violations", lambda v: F.concat(F.lit("["), v.field, F.lit(": "), v.message, F.lit("]")))
    return _checked(spark, sf).select("event_id", F.array_join(one, " ").alias("problems"))


@query("b3_violation_message", "SELECT event_id, 'Validation failed: ' || problems AS message FROM violations WHERE problems <> ''", ("violations",))
def b3(spark, sf):
    rejected = validate.split_valid(_checked(spark, sf))[1]
    return rejected.select("event_id", validate.violation_message(F.col("violations")).alias("message"))


# Features as requests carry them, some out of range.
_REQUESTS = """
    SELECT event_id, CAST(value AS DOUBLE) - 5 AS amount, CAST(event_id % 9 - 1 AS BIGINT) AS user_transaction_count_5min,
      CAST(event_id % 121 AS DOUBLE) / 100 AS merchant_risk_score, CAST(event_id % 25 AS INTEGER) AS hour_of_day,
      CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 9 AS INTEGER) END AS day_of_week,
      CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 9 AS INTEGER) END AS merchant_category,
      CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 5 AS INTEGER) END AS card_type FROM {events}"""


def _requests(spark, sf):
    from riskflow.sources.derived import table

    return spark.sql(_REQUESTS, events=table(spark, sf, "events"))


@query("b4_feature_violations", f"""
    SELECT event_id, concat_ws(',', CASE WHEN amount <= 0 THEN 'amount' END,
      CASE WHEN user_transaction_count_5min < 0 THEN 'user_transaction_count_5min' END,
      CASE WHEN merchant_risk_score < 0 OR merchant_risk_score > 1 THEN 'merchant_risk_score' END,
      CASE WHEN hour_of_day > 23 THEN 'hour_of_day' END, CASE WHEN day_of_week < 1 OR day_of_week > 7 THEN 'day_of_week' END,
      CASE WHEN merchant_category > 7 THEN 'merchant_category' END, CASE WHEN card_type > 3 THEN 'card_type' END) AS problems
    FROM ({_REQUESTS.replace('{events}', 'events')}) r""")
def b4(spark, sf):
    return validate.validate_features(_requests(spark, sf)).select(
        "event_id", F.array_join("feature_violations", ",").alias("problems"))


@query("b5_feature_defaults", f"""
    SELECT event_id, coalesce(day_of_week, 1) AS day_of_week, coalesce(merchant_category, 7) AS merchant_category,
      coalesce(card_type, 3) AS card_type, CAST(0 AS DOUBLE) AS log_amount, 0 AS distinct_merchant_count_1hour
    FROM ({_REQUESTS.replace('{events}', 'events')}) r""")
def b5(spark, sf):
    return validate.fill_feature_defaults(_requests(spark, sf)).select(
        "event_id", "day_of_week", "merchant_category", "card_type", "log_amount", "distinct_merchant_count_1hour")


@query("b6_message_names", """
    SELECT transaction_id, hour_of_day, round(log_seconds_since, 6) AS log_seconds_since, round(amount_x_merchant_risk, 6) AS amount_x_merchant_risk
    FROM features""", ("features",))
def b6(spark, sf):
    sent = feature_table(spark, sf).withColumnsRenamed({c: m for m, c in {**S.MESSAGE_FEATURE_NAMES, **S.MESSAGE_COLUMN_NAMES}.items()})
    return rounded(validate.normalise_feature_names(sent).select(
        "transaction_id", "hour_of_day", "log_seconds_since", "amount_x_merchant_risk"))


@query("b7_nested_message", """
    SELECT transaction_id, card_id, seconds_since_last_transaction, model_version, 0 AS contributions
    FROM base_features JOIN predictions USING (transaction_id)""", ("base_features", "predictions"))
def b7(spark, sf):
    flat = messages.flatten_scored(messages.nest_scored(feature_table(spark, sf).join(predictions(spark, sf), "transaction_id")))
    return flat.select("transaction_id", "card_id", "seconds_since_last_transaction", "model_version",
                       F.size("contributions").alias("contributions"))


@query("b8_encode_categories", """
    SELECT transaction_id, CASE category WHEN 'GROCERY' THEN 0 WHEN 'RESTAURANT' THEN 1 WHEN 'ENTERTAINMENT' THEN 2 WHEN 'TRAVEL' THEN 3
        WHEN 'HEALTHCARE' THEN 4 WHEN 'EDUCATION' THEN 5 WHEN 'UTILITIES' THEN 6 ELSE 7 END AS merchant_category,
      CASE WHEN is_fraud THEN 3 ELSE CASE type WHEN 'CREDIT' THEN 0 WHEN 'DEBIT' THEN 1 WHEN 'CREDIT_AND_DEBIT' THEN 2 ELSE 3 END END AS card_type
    FROM transactions JOIN merchants USING (merchant_id) JOIN cards USING (card_id)""", ("transactions", "merchants", "cards"))
def b8(spark, sf):
    joined = transactions(spark, sf).join(derived(spark, sf, "merchants"), "merchant_id").join(derived(spark, sf, "cards").drop("creation_date_time"), "card_id")
    return joined.select(
        "transaction_id", scalar.encode_category(F.col("category")).alias("merchant_category"),
        scalar.encode_card_type(F.when(F.col("is_fraud"), "UNKNOWN").otherwise(F.col("type"))).alias("card_type"))


@query("b9_high_risk", "SELECT transaction_id, fraud_probability FROM predictions WHERE risk_level = 'HIGH'", ("predictions",))
def b9(spark, sf):
    return outbox.high_risk(predictions(spark, sf)).select("transaction_id", "fraud_probability")


@query("b10_threshold_risk_level", """
    SELECT transaction_id, CASE WHEN fraud_probability >= 0.8 THEN 'HIGH' WHEN fraud_probability >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
    FROM predictions""", ("predictions",))
def b10(spark, sf):
    return predictions(spark, sf).select("transaction_id", scalar.risk_level(F.col("fraud_probability"), 0.8).alias("risk_level"))


@query("b11_fixed_bands", "SELECT transaction_id, risk_level, is_marked_as_safe FROM predictions", ("predictions",))
def b11(spark, sf):
    p = F.col("fraud_probability")
    return predictions(spark, sf).select("transaction_id", scalar.risk_band(p).alias("risk_level"), scalar.is_safe(p).alias("is_marked_as_safe"))


@query("b12_capped_features", """
    SELECT transaction_id, round(least(amount_x_merchant_risk, 50.0), 6) AS amount_x_merchant_risk,
      round(least(velocity_amount_interaction, 1.5), 6) AS velocity_amount_interaction FROM features""", ("features",))
def b12(spark, sf):
    caps = {"amount_x_merchant_risk": 50.0, "velocity_amount_interaction": 1.5}
    return rounded(feature_table(spark, sf).select("transaction_id", *[scalar.at_most(F.col(c), v).alias(c) for c, v in caps.items()]))


@query("b14_assembled_vector", """
    SELECT transaction_id, 31 AS n, round(CAST(amount AS DOUBLE) + hour_of_day + CASE WHEN is_night THEN 1 ELSE 0 END, 6) AS checked
    FROM features""", ("features",))
def b14(spark, sf):
    v = vector_to_array("features")
    at = {n: v[i] for i, n in enumerate(S.FEATURES)}
    assembler = VectorAssembler(inputCols=list(S.FEATURES), outputCol="features", handleInvalid="keep")
    df = assembler.transform(numeric_features(feature_table(spark, sf)))
    return rounded(df.select(
        "transaction_id", F.size(v).alias("n"), (at["amount"] + at["hour_of_day"] + at["is_night"]).alias("checked")))


@query("b16_parse_members", """
    SELECT transaction_id, CASE WHEN is_fraud THEN NULL ELSE CAST(amount AS DOUBLE) END AS member_amount,
      CASE WHEN is_fraud THEN transaction_id || ':' ELSE merchant_id END AS member_merchant FROM transactions""", ("transactions",))
def b16(spark, sf):
    joined = lambda c: F.concat("transaction_id", F.lit(":"), F.when(F.col("is_fraud"), "").otherwise(c.cast("string")))
    return rounded(transactions(spark, sf).select(
        "transaction_id", scalar.member_amount(joined(F.col("amount"))).alias("member_amount"),
        scalar.member_merchant(joined(F.col("merchant_id"))).alias("member_merchant")))


def _alerted(spark, sf):
    """HIGH rows with all features and contributions proportional to a few of them."""
    df = outbox.high_risk(feature_table(spark, sf).join(predictions(spark, sf), "transaction_id"))
    names = ["hour_of_day", "day_of_week", "merchant_category", "card_type", "user_historical_transaction_count", "merchant_risk_score"]
    values = [F.col(n) for n in names]
    weights = [0.25, -0.5, 0.125, -0.25, 0.0625, 2.0]
    return df.withColumn("contributions", explain.top_contributions(
        explain.as_contributions(names, values, [v * F.lit(w) for v, w in zip(values, weights)])))


def _fixed(expr: str, digits: int) -> str:
    """Decimal text rounded half up, as the alert formats print it."""
    return f"CAST(CAST(round(CAST({expr} AS DECIMAL(30,12)), {digits}) AS DECIMAL(18,{digits})) AS VARCHAR)"


@query("b17_alert_context", f"""
    SELECT transaction_id, 'Transaction:' || chr(10) || '  - Transaction ID: ' || transaction_id || chr(10) || '  - Amount: $' || amount || chr(10)
      || '  - Country: ' || country_code || chr(10) || '  - IP Address: ' || coalesce(ip_address, 'null') || chr(10)
      || '  - Device ID: ' || coalesce(device_id, 'null') || chr(10) || '  - Merchant ID: ' || merchant_id || chr(10)
      || '  - Timestamp: ' || strftime(creation_date_time, '%Y-%m-%dT%H:%M:%S') || chr(10) || chr(10)
      || 'Model Prediction:' || chr(10) || '  - Fraud Probability: ' || {_fixed('fraud_probability * 100', 2)} || '%' || chr(10)
      || '  - Risk Level: ' || risk_level AS context
    FROM scored WHERE risk_level = 'HIGH'""", ("scored",))
def b17(spark, sf):
    """The first two sections of the text (the rest prints feature values of F20)."""
    text = alerts.alert_context(_alerted(spark, sf))
    return text.select("transaction_id", F.substring_index("context", "\n\nBehavioral", 1).alias("context"))


@query("b17_alert_context_features", """
    SELECT transaction_id, 5 AS feature_lines, '  - Transactions in Last 5 Minutes: ' || user_transaction_count_5min AS count_line,
      '  - Seconds Since Last Transaction: ' || seconds_since_last_transaction AS recency_line,
      '  - Is Night Transaction: ' || CASE WHEN hour_of_day < 6 OR hour_of_day >= 22 THEN 'true' ELSE 'false' END AS night_line
    FROM base_features JOIN predictions USING (transaction_id) WHERE risk_level = 'HIGH'""", ("base_features", "predictions"))
def b17_features(spark, sf):
    lines = F.split("context", "\n")
    line = lambda label: F.element_at(F.filter(lines, lambda x: F.contains(x, F.lit(label))), 1)
    return alerts.alert_context(_alerted(spark, sf)).select(
        "transaction_id", F.size(F.filter(lines, lambda x: F.contains(x, F.lit("SHAP contribution:")))).alias("feature_lines"),
        line("Transactions in Last 5 Minutes").alias("count_line"), line("Seconds Since Last").alias("recency_line"),
        line("Is Night").alias("night_line"))


_LEFT_OUT = ("ip_risk_score", "is_night")


@query("b13_contract_report", ", f(feature) AS (VALUES " + ", ".join(f"('{n}')" for n in S.FEATURES) + f""")
    SELECT feature, feature NOT IN {_LEFT_OUT} AS available, CASE WHEN feature IN {_LEFT_OUT} THEN 0 ELSE n END AS present
    FROM f, (SELECT count(*) AS n FROM transactions) t""", ("transactions",))
def b13(spark, sf):
    """The feature table without two of its columns, against what a model asks for."""
    return validate.contract_report(feature_table(spark, sf).drop(*_LEFT_OUT), S.FEATURES)


@query("b18_alert_html")
def b18(spark, sf):
    explanations = alerts.alert_context(_alerted(spark, sf)).withColumnRenamed("context", "explanation")
    return alerts.alert_html(_alerted(spark, sf), explanations)


@query("b19_without_ids", "SELECT is_fraud, count(*) AS n FROM transactions GROUP BY is_fraud", ("transactions",))
def b19(spark, sf):
    return training_set(spark, sf).drop("transaction_id", "user_id", "absent").groupBy("is_fraud").agg(F.count("*").alias("n"))


@query("b20_default_contributions", "SELECT transaction_id, CASE WHEN is_fraud THEN 0 ELSE 1 END AS contributions FROM transactions", ("transactions",))
def b20(spark, sf):
    some = explain.as_contributions(["hour_of_day"], [F.col("hour_of_day")], [F.col("hour_of_day") * 0.1])
    df = feature_table(spark, sf).join(predictions(spark, sf), "transaction_id")
    df = df.withColumn("contributions", F.when(~F.col("is_fraud"), some))
    return messages.flatten_scored(messages.nest_scored(df)).select("transaction_id", F.size("contributions").alias("contributions"))


# ---- G and H rows over tables ----
@query("g1_top_contributions", """
    SELECT transaction_id, CAST(rank AS BIGINT) AS rank, feature_name, round(contribution, 6) AS contribution, direction FROM (
      SELECT transaction_id, feature_name, contribution, CASE WHEN contribution >= 0 THEN 'INCREASED_FRAUD_RISK' ELSE 'DECREASED_FRAUD_RISK' END AS direction,
        row_number() OVER (PARTITION BY transaction_id ORDER BY abs(contribution) DESC, i) AS rank
      FROM (SELECT f.transaction_id, x.i, x.feature_name, CASE x.i WHEN 0 THEN hour_of_day * 0.25 WHEN 1 THEN day_of_week * -0.5
              WHEN 2 THEN merchant_category * 0.125 WHEN 3 THEN card_type * -0.25 WHEN 4 THEN user_historical_transaction_count * 0.0625
              ELSE merchant_risk_score * 2.0 END AS contribution
            FROM base_features f JOIN predictions p ON p.transaction_id = f.transaction_id AND p.risk_level = 'HIGH',
              (VALUES (0, 'hour_of_day'), (1, 'day_of_week'), (2, 'merchant_category'), (3, 'card_type'),
                (4, 'user_historical_transaction_count'), (5, 'merchant_risk_score')) x(i, feature_name)) c) r
    WHERE rank <= 5""", ("base_features", "predictions"))
def g1(spark, sf):
    return rounded(explain.long_contributions(_alerted(spark, sf)).select(
        "transaction_id", F.col("rank").cast("long").alias("rank"), "feature_name", "contribution", "direction"))


@query("g4_due_tasks", """
    SELECT transaction_id, status, next_retry_at FROM tasks
    WHERE status IN ('PENDING_LLM', 'PENDING_EMAIL') AND next_retry_at <= TIMESTAMP '2024-01-15 00:00:00'
    ORDER BY next_retry_at, transaction_id LIMIT 50""", ("tasks",))
def g4(spark, sf):
    return outbox.due_tasks(derived(spark, sf, "tasks"), _status_now()).select("transaction_id", "status", "next_retry_at")


@query("g5_latest_model", """
    SELECT object_name, released_at FROM model_releases WHERE starts_with(object_name, 'lgbm_')
    ORDER BY released_at DESC, object_name DESC LIMIT 1""", ("model_releases",))
def g5(spark, sf):
    return registry.latest_model(derived(spark, sf, "model_releases"))


@query("g6_shuffled_rows", "SELECT transaction_id FROM transactions", ("transactions",))
def g6(spark, sf):
    from riskflow.operators.quality import shuffled

    return shuffled(transactions(spark, sf)).select("transaction_id")


@query("h4_deduplicated", "SELECT transaction_id, user_id, CAST(amount AS DOUBLE) AS amount FROM transactions", ("transactions",))
def h4(spark, sf):
    """Every event delivered once more, every HIGH one three times."""
    again = transactions(spark, sf)
    doubled = again.unionByName(again).unionByName(outbox.high_risk(scored(spark, sf)).select(*again.columns))
    return rounded(validate.deduplicate(doubled).select("transaction_id", "user_id", "amount"))


@query("h6_failure_routing", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'dead_letter'
        ELSE CASE WHEN event_id % 5 >= 3 THEN 'dead_letter' ELSE 'retry' END END AS route,
      CASE WHEN event_id % 4 >= 2 AND event_id % 5 < 3 THEN CAST(least(10000, 1000 * pow(2, event_id % 5)) AS BIGINT) END AS delay_ms
    FROM events""")
def h6(spark, sf):
    from riskflow.sources.derived import table

    events = table(spark, sf, "events").select("event_id")
    kind = F.col("event_id") % 4
    error = F.when(kind == 1, "validation").when(kind >= 2, "timeout")
    return validate.route_failures(events, error, F.col("event_id") % 5)


@query("h7_enqueued_alerts", """
    SELECT transaction_id, 'PENDING_LLM' AS status, 0 AS attempts, TIMESTAMP '2024-01-15 00:00:00' AS next_retry_at,
      TIMESTAMP '2024-01-15 00:00:00' AS created_at, transaction_id || ' ' || risk_level || ' ' || model_version AS payload
    FROM predictions WHERE risk_level = 'HIGH' AND transaction_id NOT IN (SELECT transaction_id FROM tasks)""", ("predictions", "tasks"))
def h7(spark, sf):
    payload = F.concat_ws(" ", "transaction_id", "risk_level", "model_version")
    return outbox.enqueue_alerts(predictions(spark, sf), derived(spark, sf, "tasks"), _status_now(), payload)


_TRANSITION = """
    SELECT transaction_id,
      CASE WHEN NOT acts THEN status WHEN failed AND attempts + 1 >= 5 THEN 'DEAD_LETTER' WHEN status = 'PENDING_LLM' AND NOT llm_ok THEN 'PENDING_LLM'
           WHEN NOT email_ok THEN 'PENDING_EMAIL' ELSE 'COMPLETED' END AS status,
      CASE WHEN acts AND failed THEN attempts + 1 ELSE attempts END AS attempts,
      CASE WHEN acts AND failed AND attempts + 1 < 5 THEN TIMESTAMP '2024-01-15 00:00:00' + CAST(30 * pow(2, attempts) AS INTEGER) * INTERVAL '1' SECOND
           ELSE next_retry_at END AS next_retry_at,
      'p-' || transaction_id AS payload, CASE WHEN acts AND (status <> 'PENDING_LLM' OR llm_ok) THEN 'why ' || transaction_id END AS explanation,
      CASE WHEN acts AND NOT failed THEN 'mail ' || transaction_id END AS mail,
      CASE WHEN acts AND failed THEN CASE WHEN status = 'PENDING_LLM' AND NOT llm_ok THEN 'explanation failed' ELSE 'mail failed' END
           WHEN NOT acts THEN 'before' END AS error_message,
      CASE WHEN acts THEN TIMESTAMP '2024-01-15 00:00:00' END AS last_attempt_at, CAST(NULL AS TIMESTAMP) AS created_at,
      CASE WHEN acts AND NOT failed THEN TIMESTAMP '2024-01-15 00:00:00' WHEN status = 'COMPLETED' THEN next_retry_at END AS completed_at
    FROM (SELECT t.*, o.llm_ok, o.email_ok,
            status IN ('PENDING_LLM', 'PENDING_EMAIL') AND next_retry_at <= TIMESTAMP '2024-01-15 00:00:00' AS acts,
            (status = 'PENDING_LLM' AND NOT llm_ok) OR NOT email_ok AS failed
          FROM tasks t JOIN outcomes o USING (transaction_id)) x"""


@query("h8_task_transition", _TRANSITION, ("tasks", "outcomes"))
def h8(spark, sf):
    tasks = derived(spark, sf, "tasks").withColumns({
        "payload": F.concat(F.lit("p-"), "transaction_id"), "error_message": F.lit("before"),
        "completed_at": F.when(F.col("status") == "COMPLETED", F.col("next_retry_at"))})
    outcomes = derived(spark, sf, "outcomes").withColumns({
        "explanation": F.concat(F.lit("why "), "transaction_id"), "mail": F.concat(F.lit("mail "), "transaction_id")})
    return outbox.advance_tasks(tasks, outcomes, _status_now())


@query("h8_latest_task_state", f"SELECT n.transaction_id, n.status, n.attempts FROM ({_TRANSITION}) n", ("tasks", "outcomes"))
def h8_latest(spark, sf):
    tasks = derived(spark, sf, "tasks")
    before = tasks.withColumn("updated_at", _status_now() - F.expr("INTERVAL '1' HOUR"))
    after = outbox.advance_tasks(tasks, derived(spark, sf, "outcomes"), _status_now()).withColumn("updated_at", _status_now())
    return outbox.latest_state(before.unionByName(after.select(*before.columns))).select("transaction_id", "status", "attempts")
