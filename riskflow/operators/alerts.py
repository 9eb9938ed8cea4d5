"""Alert texts for HIGH transactions: analyst context and HTML mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: context sections as (label, format, column) ---------------------------------
CONTEXT = [
    ("Transaction", [
        ("Transaction ID", "%s", "transaction_id"),
        ("Amount", "$%s", "amount"),
        ("Country", "%s", "country_code"),
        ("IP Address", "%s", "ip_address"),
        ("Device ID", "%s", "device_id"),
        ("Merchant ID", "%s", "merchant_id"),
        ("Timestamp", "%s", "creation_date_time"),
    ]),
    ("Model Prediction", [
        ("Fraud Probability", "%.2f%%", "fraud_percent"),
        ("Risk Level", "%s", "risk_level"),
    ]),
    ("Behavioral Context", [
        ("User Average Amount", "$%s", "user_average_amount"),
        ("Amount-to-Average Ratio", "%.2f", "amount_to_average_ratio"),
        ("Transactions in Last 5 Minutes", "%d", "user_transaction_count_5min"),
        ("Transactions in Last Hour", "%d", "user_transaction_count_1hour"),
        ("Seconds Since Last Transaction", "%d", "seconds_since_last_transaction"),
        ("Amount Velocity (Last Hour)", "$%s", "amount_velocity_1hour"),
        ("Distinct Merchants (Last Hour)", "%d", "distinct_merchant_count_1hour"),
        ("Card Age (Days)", "%d", "card_age_days"),
        ("Account Age (Days)", "%d", "user_account_age_days"),
        ("Hour of Day", "%d", "hour_of_day"),
    ]),
    ("Risk Indicators", [
        ("Merchant Risk Score", "%.2f", "merchant_risk_score"),
        ("IP Risk Score", "%.2f", "ip_risk_score"),
        ("Device Trusted", "%s", "is_device_trusted"),
        ("Country Mismatch", "%s", "has_country_mismatch"),
        ("Is Night Transaction", "%s", "is_night"),
    ]),
]
CONTEXT_LAST = "Top SHAP Contributing Features (ranked by model impact)"
CONTEXT_FEATURE = "  - %s = %s (SHAP contribution: %.4f, direction: %s)"

# --- fixed values: mail sections as (label, format, column) --------------------------------------
MAIL = [
    ("Transaction Details", [
        ("Transaction ID", "%s", "transaction_id"), ("User ID", "%s", "user_id"), ("Card ID", "%s", "card_id"),
        ("Merchant ID", "%s", "merchant_id"), ("Device ID", "%s", "device_id"), ("Amount", "$%s", "amount"),
        ("Country", "%s", "country_code"), ("IP Address", "%s", "ip_address"), ("Timestamp", "%s", "creation_date_time"),
    ]),
    ("Risk Assessment", [
        ("Risk Level", "%s", "risk_level"), ("Fraud Probability", "%.2f%%", "fraud_percent"),
        ("Model Version", "%s", "model_version"),
    ]),
    ("Fraud Detection Features", [
        ("User Average Amount", "$%s", "user_average_amount"), ("Amount-to-Average Ratio", "%.2f", "amount_to_average_ratio"),
        ("Transactions (last 5 min)", "%d", "user_transaction_count_5min"),
        ("Transactions (last 1 hour)", "%d", "user_transaction_count_1hour"),
        ("Seconds Since Last Transaction", "%d", "seconds_since_last_transaction"),
        ("Merchant Risk Score", "%.2f", "merchant_risk_score"), ("IP Risk Score", "%.2f", "ip_risk_score"),
        ("Device Trusted", "%s", "is_device_trusted"), ("Country Mismatch", "%s", "has_country_mismatch"),
        ("Card Age (days)", "%d", "card_age_days"), ("Hour of Day", "%d", "hour_of_day"),
        ("Amount Velocity (1 Hour)", "$%s", "amount_velocity_1hour"), ("User Account Age (days)", "%d", "user_account_age_days"),
        ("Day of Week", "%d", "day_of_week"), ("Merchant Category", "%d", "merchant_category"),
        ("Card Type", "%d", "card_type"), ("Distinct Merchants (1 Hour)", "%d", "distinct_merchant_count_1hour"),
    ]),
    ("Engineered Features", [
        ("Log Amount", "%.4f", "log_amount"), ("Log Seconds Since Last Transaction", "%.4f", "log_seconds_since"),
        ("Log Velocity (1 Hour)", "%.4f", "log_velocity_1hour"), ("Amount × Merchant Risk", "%.4f", "amount_x_merchant_risk"),
        ("Risk Score Product", "%.4f", "risk_score_product"), ("IP Device Risk", "%.4f", "ip_device_risk"),
        ("Country IP Risk", "%.4f", "country_ip_risk"), ("Velocity Amount Interaction", "%.4f", "velocity_amount_interaction"),
        ("Recency Velocity", "%.4f", "recency_velocity"), ("Amount Deviation", "%.4f", "amount_deviation"),
        ("Is Night", "%s", "is_night"), ("Velocity Intensity", "%.4f", "velocity_intensity"),
    ]),
]
MAIL_TITLE = "Fraud Alert — Transaction "
MAIL_LAST, MAIL_ANALYSIS = "Top Contributing Features", "AI Analysis"
MAIL_COLUMNS = ["Feature", "Value", "Contribution", "Direction"]

_MONEY_COLUMNS = ("user_average_amount", "amount_velocity_1hour")


def _value(column: str) -> Column:
    if column == "fraud_percent":
        return F.col("fraud_probability") * 100
    if column == "creation_date_time":
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    if column in _MONEY_COLUMNS:
        return F.col(column).cast("decimal(19,2)")
    return F.col(column)


def _number(v: Column) -> Column:
    """A whole value prints without decimals."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def alert_context(scored: DataFrame) -> DataFrame:
    """transaction_id and the plain-text context: sections, then one line per top feature."""
    formats, values = [], []
    for section, lines in CONTEXT:
        formats.append("\n".join([f"{section}:", *[f"  - {label}: {fmt}" for label, fmt, _ in lines]]))
        values += [_value(c) for _, _, c in lines]
    features = F.array_join(
        F.transform("contributions", lambda x: F.format_string(
            CONTEXT_FEATURE, x.feature_name, _number(x.feature_value), x.contribution, x.direction)), "\n")
    text = F.format_string("\n\n".join([*formats, CONTEXT_LAST + ":\n%s\n"]), *values, features)
    return scored.select("transaction_id", text.alias("context"))


def escape_html(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit("null"))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def alert_html(scored: DataFrame, explanations: DataFrame) -> DataFrame:
    """transaction_id, subject and HTML body; every text value is escaped."""
    parts = [F.lit("<html><body><h1>Fraud Alert — Transaction "), escape_html(F.col("transaction_id")), F.lit("</h1>")]
    for section, lines in MAIL:
        parts.append(F.lit(f"<h2>{section}</h2><table>"))
        for label, fmt, column in lines:
            shown = F.format_string(fmt, escape_html(_value(column)) if fmt.endswith("%s") else _value(column))
            parts += [F.lit(f"<tr><th>{label}</th><td>"), shown, F.lit("</td></tr>")]
        parts.append(F.lit("</table>"))
    head = "".join(f"<th>{c}</th>" for c in MAIL_COLUMNS)
    rows = F.array_join(
        F.transform("contributions", lambda x: F.format_string(
            "<tr><td>%s</td><td>%s</td><td>%.4f</td><td>%s</td></tr>",
            escape_html(x.feature_name), _number(x.feature_value), x.contribution, escape_html(x.direction))), "\n")
    parts += [
        F.lit(f"<h2>{MAIL_LAST}</h2><table><tr>{head}</tr>"), rows,
        F.lit(f"</table><h2>{MAIL_ANALYSIS}</h2><p>"), escape_html(F.col("explanation")), F.lit("</p></body></html>"),
    ]
    return scored.join(explanations.select("transaction_id", "explanation"), "transaction_id").select(
        "transaction_id", F.concat(F.lit(MAIL_TITLE), F.col("transaction_id")).alias("subject"),
        F.concat(*parts).alias("body"))
