"""Evaluation metrics, training-set quality and monitoring aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow import schemas as S
from riskflow.catalog.checks import add_block
from riskflow.catalog.inputs import predictions, rounded, scored, training_set, transactions
from riskflow.catalog.registry import query
from riskflow.operators import evaluate, monitor, outbox, quality, quantiles, validate
from riskflow.sources.derived import derived


def _now():
    return F.expr("timestamp_ntz'2024-01-28 00:00:00'")


def _eval(spark, sf):
    return derived(spark, sf, "eval_scores")


# ---- D4-D9 ----
@query("d4_class_counts", """
    SELECT count(*) FILTER (WHERE NOT is_fraud) AS negatives, count(*) FILTER (WHERE is_fraud) AS positives,
      round(count(*) FILTER (WHERE NOT is_fraud) / count(*) FILTER (WHERE is_fraud), 6) AS scale_pos_weight FROM transactions""", ("transactions",))
def d4(spark, sf):
    return rounded(evaluate.class_counts(transactions(spark, sf)))


def _bucket_sql(column: str, edges: list, names: list, block: str) -> str:
    arms = f"CASE WHEN {column} < {edges[0]} THEN NULL " + " ".join(
        f"WHEN {column} <= {e} THEN {i}" for i, e in enumerate(edges[1:])) + f" ELSE {len(edges) - 1} END"
    listed = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"""
    SELECT l.position, l.bucket, coalesce(s.n, 0) AS transactions, round(s.fraud_rate, 6) AS fraud_rate
    FROM (VALUES {listed}) l(position, bucket) LEFT JOIN (
      SELECT {arms} AS position, count(*) AS n, avg(CASE WHEN is_fraud THEN 1.0 ELSE 0.0 END) AS fraud_rate FROM {block} GROUP BY 1) s USING (position)"""


@query("d5_fraud_rate_by_amount", _bucket_sql("amount", S.AMOUNT_EDGES, S.AMOUNT_LABELS, "transactions"), ("transactions",))
def d5(spark, sf):
    return rounded(evaluate.bucket_rates(transactions(spark, sf), "amount", S.AMOUNT_EDGES, S.AMOUNT_LABELS))


@query("d6_fraud_rate_by_ratio", _bucket_sql("amount_to_average_ratio", S.RATIO_EDGES, S.RATIO_LABELS, "base_features"), ("base_features",))
def d6(spark, sf):
    return rounded(evaluate.bucket_rates(training_set(spark, sf), "amount_to_average_ratio", S.RATIO_EDGES, S.RATIO_LABELS))


_COLD = "user_historical_transaction_count = 0"


@query("d7_no_history_rates", f"""
    SELECT count(*) FILTER (WHERE {_COLD}) AS no_history, round(avg(CASE WHEN is_fraud THEN 1.0 ELSE 0.0 END) FILTER (WHERE {_COLD}), 6) AS no_history_rate,
      count(*) FILTER (WHERE {_COLD} AND amount >= 10000) AS large_no_history,
      round(avg(CASE WHEN is_fraud THEN 1.0 ELSE 0.0 END) FILTER (WHERE {_COLD} AND amount >= 10000), 6) AS large_no_history_rate
    FROM transactions JOIN history USING (transaction_id)""", ("transactions", "history"))
def d7(spark, sf):
    return rounded(evaluate.no_history_rates(training_set(spark, sf)))


@query("d9_feature_caps", """
    SELECT round(quantile_cont(amount_x_merchant_risk, 0.99), 6) AS amount_x_merchant_risk,
      round(quantile_cont(velocity_amount_interaction, 0.99), 6) AS velocity_amount_interaction FROM features""", ("features",))
def d9(spark, sf):
    from riskflow.catalog.inputs import feature_table

    caps = quantiles.fit_caps(feature_table(spark, sf), S.CAPPED_FEATURES)
    return rounded(spark.createDataFrame([tuple(caps[c] for c in S.CAPPED_FEATURES)], [*S.CAPPED_FEATURES]))


# ---- D10-D12, J ----
def _unpivot(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, is_fraud FROM base_features" for c in columns)


add_block("continuous", ("base_features",), _unpivot(quality.CONTINUOUS_OVERLAP))
add_block("categorical", ("base_features",), _unpivot(quality.CATEGORICAL_OVERLAP))
add_block("numeric", ("base_features",), _unpivot(quality.AUC_FEATURES))
add_block("plotted", ("base_features",), _unpivot(quality.PLOT_FEATURES))


def _binned(block: str) -> str:
    return f"""
        SELECT feature, lo, hi, p, l, CASE WHEN hi > lo THEN CAST(least(floor((value - lo) * 50 / (hi - lo)), 49) AS INTEGER) ELSE 0 END AS bin,
          count(*) FILTER (WHERE is_fraud) AS fraud, count(*) FILTER (WHERE NOT is_fraud) AS legit
        FROM {block} JOIN (SELECT feature, min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE is_fraud) AS p,
            count(*) FILTER (WHERE NOT is_fraud) AS l FROM {block} GROUP BY feature) r USING (feature)
        GROUP BY ALL"""


add_block("overlap_rows", ("continuous",), f"""
    SELECT feature, round(least(1.0, sum(least(fraud / p, legit / l))), 4) AS overlap FROM ({_binned('continuous')}) b GROUP BY feature""")
add_block("category_overlaps", ("categorical",), """
    SELECT feature, round(least(1.0, sum(least(fraud / p, legit / l))), 4) AS overlap FROM (
      SELECT feature, count(*) FILTER (WHERE is_fraud) AS fraud, count(*) FILTER (WHERE NOT is_fraud) AS legit,
        sum(count(*) FILTER (WHERE is_fraud)) OVER (PARTITION BY feature) AS p, sum(count(*) FILTER (WHERE NOT is_fraud)) OVER (PARTITION BY feature) AS l
      FROM categorical GROUP BY feature, value) b GROUP BY feature""")
add_block("aucs", ("numeric",), """
    SELECT feature, round(greatest(a, 1 - a), 4) AS auc FROM (
      SELECT feature, (sum(CASE WHEN is_fraud THEN r END) - count(*) FILTER (WHERE is_fraud) * (count(*) FILTER (WHERE is_fraud) + 1) / 2)
        / (CAST(count(*) FILTER (WHERE is_fraud) AS DOUBLE) * count(*) FILTER (WHERE NOT is_fraud)) AS a
      FROM (SELECT feature, is_fraud, rank() OVER (PARTITION BY feature ORDER BY value)
              + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM numeric) x GROUP BY feature) y""")
add_block("summary", ("overlap_rows", "category_overlaps", "aucs", "base_features"), f"""
    SELECT count(*) AS total_rows, count(*) FILTER (WHERE is_fraud) AS fraud_count, count(*) FILTER (WHERE NOT is_fraud) AS legit_count,
      round(avg(CASE WHEN is_fraud THEN 1.0 ELSE 0.0 END), 4) AS fraud_rate,
      (SELECT round(avg(overlap), 4) FROM (SELECT * FROM overlap_rows UNION ALL SELECT * FROM category_overlaps) o) AS avg_overlap,
      (SELECT max(auc) FROM aucs) AS max_single_feature_auc,
      count(*) FILTER (WHERE {_COLD} AND amount >= 10000) AS large_cold_start_count,
      round(coalesce(avg(CASE WHEN is_fraud THEN 1.0 ELSE 0.0 END) FILTER (WHERE {_COLD} AND amount >= 10000), 0.0), 4) AS large_cold_start_fraud_rate,
      round(coalesce(avg(CASE WHEN is_fraud THEN 1.0 ELSE 0.0 END) FILTER (WHERE {_COLD} AND amount >= 10000), 0.0)
        / greatest(avg(CASE WHEN is_fraud THEN 1.0 ELSE 0.0 END), 0.0001), 2) AS large_cold_start_lift
    FROM base_features""")


@query("d8_dataset_summary", "SELECT * FROM summary", ("summary",))
def d8(spark, sf):
    return quality.dataset_summary(training_set(spark, sf))


@query("d10_continuous_overlap", "SELECT * FROM overlap_rows", ("overlap_rows",))
def d10(spark, sf):
    return quality.overlap(training_set(spark, sf))


@query("d11_categorical_overlap", "SELECT * FROM category_overlaps", ("category_overlaps",))
def d11(spark, sf):
    return quality.categorical_overlap(training_set(spark, sf))


@query("d12_single_feature_auc", "SELECT * FROM aucs", ("aucs",))
def d12(spark, sf):
    return quality.single_feature_auc(training_set(spark, sf))


@query("g3_top_aucs", "SELECT * FROM aucs ORDER BY auc DESC, feature LIMIT 10", ("aucs",))
def g3(spark, sf):
    return quality.top_aucs(training_set(spark, sf), max_group_rows=500)


@query("g8_category_domains", """
    SELECT feature, value, count(*) FILTER (WHERE is_fraud) AS fraud, count(*) FILTER (WHERE NOT is_fraud) AS legit FROM categorical GROUP BY feature, value""",
       ("categorical",))
def g8(spark, sf):
    """Every value either class takes, with both counts: the union of the two domains."""
    rows = quality.long_form(training_set(spark, sf), quality.CATEGORICAL_OVERLAP, "is_fraud")
    return rows.groupBy("feature", "value").agg(
        F.count_if("positive").alias("fraud"), F.count_if(~F.col("positive")).alias("legit"))


@query("j1_overlap_report", "SELECT * FROM overlap_rows UNION ALL SELECT * FROM category_overlaps", ("overlap_rows", "category_overlaps"))
def j1(spark, sf):
    return quality.overlap_report(training_set(spark, sf))


@query("j2_leakage_report", "SELECT feature, auc, auc <= 0.78 AS acceptable FROM aucs", ("aucs",))
def j2(spark, sf):
    return quality.single_feature_auc(training_set(spark, sf)).withColumn("acceptable", F.col("auc") <= S.MAX_FEATURE_AUC)


@query("j3_acceptance", """
    SELECT avg_overlap >= 0.55 AS overlap_ok, max_single_feature_auc <= 0.78 AS leakage_ok, large_cold_start_lift >= 2.0 AS cold_start_ok FROM summary""",
       ("summary",))
def j3(spark, sf):
    return quality.acceptance(quality.dataset_summary(training_set(spark, sf)))


@query("j4_class_histograms", f"""
    SELECT feature, bin, round(lo + bin * w, 6) AS lower, fraud, legit, round(fraud / (p * w), 6) AS fraud_density, round(legit / (l * w), 6) AS legit_density
    FROM (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 50 ELSE 1.0 END AS w FROM ({_binned('plotted')}) b) c""", ("plotted",))
def j4(spark, sf):
    return rounded(quality.class_histograms(training_set(spark, sf), quality.PLOT_FEATURES).drop("upper", "_p", "_l"))


@query("j5_clipped_ranges", """
    SELECT transaction_id, CASE WHEN is_fraud THEN NULL ELSE greatest(round(CAST(amount AS DOUBLE) - 20, 6), 0.0) END AS amount,
      greatest(least(merchant_risk_score * 1.5, 1.0), 0.0) AS merchant_risk_score FROM enriched""", ("enriched",))
def j5(spark, sf):
    df = training_set(spark, sf).select(
        "transaction_id", F.when(~F.col("is_fraud"), F.round(F.col("amount").cast("double") - 20, 6)).alias("amount"),
        (F.col("merchant_risk_score") * 1.5).alias("merchant_risk_score"))
    return quality.clip_ranges(df)


@query("j6_injected_faults", """
    SELECT count(*) AS n, true AS missing_near_rate, true AS in_range FROM transactions""", ("transactions",))
def j6(spark, sf):
    """Row count kept, blanks near the set rate, ranges respected."""
    df = quality.inject_faults(training_set(spark, sf))
    missing = F.avg(F.col("amount").isNull().cast("int"))
    bad = F.count_if((F.col("amount") < 0) | (F.col("ip_risk_score") > 1) | (F.col("merchant_risk_score") < 0))
    return df.agg(F.count("*").alias("n"), missing.between(0.003, 0.02).alias("missing_near_rate"), (bad == 0).alias("in_range"))


# ---- D13-D20 ----
@query("d13_pr_curve", "SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve", ("curve",))
def d13(spark, sf):
    return rounded(evaluate.pr_curve(_eval(spark, sf), "score", "is_fraud").select("threshold", "precision", "recall"))


@query("d14_average_precision", "SELECT round(sum(gain * precision), 6) AS average_precision FROM curve", ("curve",))
def d14(spark, sf):
    return rounded(evaluate.average_precision(_eval(spark, sf), "score", "is_fraud"))


@query("d15_confusion", """
    SELECT count(*) FILTER (WHERE score < 0.5 AND NOT is_fraud) AS tn, count(*) FILTER (WHERE score >= 0.5 AND NOT is_fraud) AS fp,
      count(*) FILTER (WHERE score < 0.5 AND is_fraud) AS fn, count(*) FILTER (WHERE score >= 0.5 AND is_fraud) AS tp FROM eval_scores""", ("eval_scores",))
def d15(spark, sf):
    return evaluate.confusion(_eval(spark, sf), "score", "is_fraud", 0.5)


@query("d16_classification_report", """
    SELECT round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
      round(2 * tp / (2 * tp + fp + fn), 6) AS f1_score, tp + fn AS support
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE score < 0.5 AND NOT is_fraud) AS tn, count(*) FILTER (WHERE score >= 0.5 AND NOT is_fraud) AS fp,
      count(*) FILTER (WHERE score < 0.5 AND is_fraud) AS fn, count(*) FILTER (WHERE score >= 0.5 AND is_fraud) AS tp FROM eval_scores) c""", ("eval_scores",))
def d16(spark, sf):
    return rounded(evaluate.classification_report(_eval(spark, sf), "score", "is_fraud", 0.5))


_FBETA = """
    SELECT round(threshold, 6) AS threshold, round(f, 6) AS fbeta FROM (
      SELECT threshold, (1 + 4.0) * precision * recall / (4.0 * precision + recall) AS f FROM curve WHERE precision + recall > 0) c
    ORDER BY f DESC, threshold LIMIT 1"""


@query("d17_fbeta_threshold", _FBETA, ("curve",))
def d17(spark, sf):
    return rounded(evaluate.fbeta_threshold(_eval(spark, sf), "score", "is_fraud", 2.0))


@query("i10_threshold_metrics", f"""
    , best AS (SELECT threshold AS t FROM (SELECT threshold, (1 + 4.0) * precision * recall / (4.0 * precision + recall) AS f FROM curve) c ORDER BY f DESC, threshold LIMIT 1)
    SELECT round(t, 6) AS threshold, round((SELECT sum(gain * precision) FROM curve), 6) AS pr_auc,
      round(count(*) FILTER (WHERE (score >= t) = is_fraud) / count(*), 6) AS accuracy,
      round(count(*) FILTER (WHERE score >= t AND is_fraud) / count(*) FILTER (WHERE score >= t), 6) AS precision,
      round(count(*) FILTER (WHERE score >= t AND is_fraud) / count(*) FILTER (WHERE is_fraud), 6) AS recall,
      count(*) FILTER (WHERE is_fraud) AS support
    FROM eval_scores, best GROUP BY t""", ("curve", "eval_scores"))
def i10(spark, sf):
    df = _eval(spark, sf)
    curve = evaluate.pr_curve(df, "score", "is_fraud")
    best = evaluate.fbeta_threshold_of(curve, 2.0).first().threshold
    ap = evaluate.average_precision_of(curve).first().average_precision
    report = evaluate.classification_report(df, "score", "is_fraud", best)
    return rounded(report.select(F.lit(best).alias("threshold"), F.lit(ap).alias("pr_auc"), "accuracy", "precision", "recall", "support"))


@query("i2_class_weight", """
    SELECT transaction_id, round(CASE WHEN is_fraud THEN (SELECT count(*) FILTER (WHERE NOT is_fraud) / count(*) FILTER (WHERE is_fraud) FROM transactions) ELSE 1.0 END, 6) AS weight
    FROM transactions""", ("transactions",))
def i2(spark, sf):
    return rounded(evaluate.with_class_weight(transactions(spark, sf).select("transaction_id", "is_fraud"))).select("transaction_id", "weight")


@query("d18_tasks_by_status", """
    SELECT status, count(t.transaction_id) AS tasks FROM (VALUES ('PENDING_LLM'), ('PENDING_EMAIL'), ('COMPLETED'), ('DEAD_LETTER')) s(status)
    LEFT JOIN tasks t USING (status) GROUP BY status""", ("tasks",))
def d18(spark, sf):
    return outbox.tasks_by_status(derived(spark, sf, "tasks"))


@query("d19_processed_by_level_and_version", "SELECT risk_level, model_version, count(*) AS events FROM predictions GROUP BY 1, 2", ("predictions",))
def d19(spark, sf):
    return monitor.split_by(predictions(spark, sf), "risk_level", "model_version")


@query("d20_median_amount", """
    SELECT round(CAST(quantile_cont(CAST(amount AS DOUBLE), 0.5) AS DOUBLE), 6) AS median_amount, round(quantile_cont(risk_score, 0.5), 6) AS median_risk
    FROM transactions JOIN merchants USING (merchant_id)""", ("transactions", "merchants"))
def d20(spark, sf):
    df = transactions(spark, sf).join(derived(spark, sf, "merchants"), "merchant_id")
    both = quantiles.exact_quantiles(df, {"amount": 0.5, "risk_score": 0.5})
    return rounded(spark.createDataFrame(
        [(both["amount"], both["risk_score"])], "median_amount double, median_risk double"))


# ---- K: monitoring ----
def _minute(column: str = "creation_date_time") -> str:
    return f"date_trunc('minute', {column})"


_SPANS = "(SELECT unnest(range(5)) AS i) o"


@query("k1_scored_per_minute", f"SELECT {_minute()} AS minute, count(*) AS events FROM scored GROUP BY 1", ("scored",))
def k1(spark, sf):
    return monitor.rate(scored(spark, sf), "creation_date_time")


@query("k2_high_share", f"""
    SELECT window_start, CAST(sum(h) AS BIGINT) AS matching, CAST(count(*) AS BIGINT) AS events, round((sum(h) / 300.0) / greatest(count(*) / 300.0, 0.0001), 6) AS share
    FROM (SELECT {_minute()} - i * INTERVAL '1' MINUTE AS window_start, CASE WHEN risk_level = 'HIGH' THEN 1 ELSE 0 END AS h FROM scored, {_SPANS}) x GROUP BY 1""",
       ("scored",))
def k2(spark, sf):
    return rounded(monitor.share(scored(spark, sf), "creation_date_time", F.col("risk_level") == "HIGH"))


@query("k3_mean_probability", f"""
    SELECT window_start, count(*) AS events, round((sum(fraud_probability) / 300.0) / greatest(count(*) / 300.0, 0.0001), 6) AS mean
    FROM (SELECT {_minute()} - i * INTERVAL '1' MINUTE AS window_start, fraud_probability FROM scored, {_SPANS}) x GROUP BY 1""", ("scored",))
def k3(spark, sf):
    return rounded(monitor.mean_over(scored(spark, sf), "creation_date_time", "fraud_probability"))


def _quantile_sql() -> str:
    bounds = S.DURATION_BOUNDS
    arms = "CASE " + " ".join(f"WHEN seconds <= {b} THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {len(bounds)} END"
    uppers, lowers = str(list(bounds)), str([0.0, *bounds[:-1]])
    picks = ", ".join(
        f"round(max(CASE WHEN upto >= {q} * total AND upto - n < {q} * total THEN CASE WHEN b >= {len(bounds)} THEN {bounds[-1]} "
        f"ELSE lo + (hi - lo) * (({q} * total - (upto - n)) / n) END END), 6) AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99))
    return f"""
    SELECT window_start, CAST(max(total) AS BIGINT) AS events, {picks} FROM (
      SELECT window_start, b, n, sum(n) OVER (PARTITION BY window_start ORDER BY b) AS upto, sum(n) OVER (PARTITION BY window_start) AS total,
        CAST({uppers}[b + 1] AS DOUBLE) AS hi, CAST({lowers}[b + 1] AS DOUBLE) AS lo
      FROM (SELECT {_minute('ts')} - i * INTERVAL '1' MINUTE AS window_start, {arms} AS b, count(*) AS n FROM durations, {_SPANS} GROUP BY 1, 2) c) d
    GROUP BY window_start"""


@query("k4_latency_quantiles", _quantile_sql(), ("durations",))
def k4(spark, sf):
    return rounded(monitor.histogram_quantile(derived(spark, sf, "durations"), "ts", "seconds", [0.5, 0.95, 0.99]))


@query("k5_active_model", """
    SELECT object_name AS version, true AS active FROM model_releases WHERE starts_with(object_name, 'lgbm_')
    ORDER BY released_at DESC, object_name DESC LIMIT 1""", ("model_releases",))
def k5(spark, sf):
    from riskflow.operators.registry import latest_model

    return latest_model(derived(spark, sf, "model_releases")).select(F.col("object_name").alias("version"), F.lit(True).alias("active"))


def _letters(spark, sf):
    checked = validate.validate_transactions(derived(spark, sf, "raw_transactions"), _now())
    rejected = validate.split_valid(checked)[1]
    # Amount problems come from the scored topic's reader in this table, the rest from the first one.
    topic = F.when(F.exists("violations", lambda v: v.field == "amount"), "transactions.scored").otherwise("transactions.created")
    return rejected.select(topic.alias("topic"), F.coalesce("creation_date_time", F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("ts"))


@query("k6_dead_letters_total", """
    SELECT (SELECT count(*) FROM violations WHERE problems <> '') + (SELECT count(*) FROM tasks WHERE status = 'DEAD_LETTER') AS dead_letters""",
       ("violations", "tasks"))
def k6(spark, sf):
    return monitor.dead_letters_total(_letters(spark, sf), derived(spark, sf, "tasks"))


@query("k7_rate_by_risk_level", f"SELECT {_minute()} AS minute, risk_level, count(*) AS events FROM scored GROUP BY 1, 2", ("scored",))
def k7(spark, sf):
    return monitor.rate(scored(spark, sf), "creation_date_time", ["risk_level"])


@query("k8_probability_distribution", f"""
    SELECT {_minute()} AS minute, CAST(le AS DOUBLE) AS le, count(*) FILTER (WHERE fraud_probability <= le) AS events
    FROM scored, (SELECT unnest({S.PROBABILITY_BOUNDS}) AS le) b GROUP BY 1, 2""", ("scored",))
def k8(spark, sf):
    return monitor.histogram(scored(spark, sf), "creation_date_time", "fraud_probability")


@query("k9_risk_level_split", "SELECT risk_level, count(*) AS events FROM predictions GROUP BY 1", ("predictions",))
def k9(spark, sf):
    return monitor.split_by(predictions(spark, sf), "risk_level")


@query("k10_funnel", f"""
    SELECT {_minute()} AS minute, count(*) AS ingested, count(p.transaction_id) AS scored, count(p.transaction_id) FILTER (WHERE p.risk_level = 'HIGH') AS alerted
    FROM transactions t LEFT JOIN predictions p USING (transaction_id) GROUP BY 1""", ("transactions", "predictions"))
def k10(spark, sf):
    some = scored(spark, sf)
    return monitor.funnel(transactions(spark, sf), some, outbox.high_risk(some), "creation_date_time")


@query("k11_dead_letter_rate_by_topic", f"""
    SELECT window_start, topic, count(*) AS events, round(count(*) / 300.0, 6) AS per_second FROM (
      SELECT {_minute('ts')} - i * INTERVAL '1' MINUTE AS window_start, topic
      FROM (SELECT CASE WHEN problems LIKE '%[amount:%' THEN 'transactions.scored' ELSE 'transactions.created' END AS topic,
              coalesce(creation_date_time, TIMESTAMP '2024-01-01 00:00:00') AS ts FROM violations WHERE problems <> '') v, {_SPANS}) x GROUP BY 1, 2""",
       ("violations",))
def k11(spark, sf):
    return rounded(monitor.sliding_rate(_letters(spark, sf), "ts", ["topic"]))


@query("k12_outbox_by_status", "SELECT status, count(*) AS tasks FROM tasks GROUP BY status", ("tasks",))
def k12(spark, sf):
    return outbox.tasks_by_status(derived(spark, sf, "tasks"))
