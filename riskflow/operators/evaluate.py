"""Classifier evaluation: curves, thresholds, confusion counts, rates by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskflow import schemas as S
from riskflow.operators.ordered import MAX_GROUP_ROWS, Agg, running, written


def _positive(label: str) -> Column:
    return F.col(label).cast("boolean")


def class_counts(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """One row: negatives, positives and their ratio."""
    return df.agg(
        F.count_if(~_positive(label)).alias("negatives"), F.count_if(_positive(label)).alias("positives")
    ).withColumn("scale_pos_weight", F.col("negatives") / F.nullif(F.col("positives"), F.lit(0)))


def with_class_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Adds `weight`: the class ratio for positives, 1 for the rest."""
    ratio = class_counts(df, label).first()["scale_pos_weight"]
    return df.withColumn("weight", F.when(_positive(label), F.lit(float(ratio or 1.0))).otherwise(1.0))


def pr_curve(df: DataFrame, score: str, label: str, *, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """threshold, tp, fp, precision, recall at every distinct score (rows scoring at least it).

    The rows are read once: they collapse to distinct scores, which are written; the running sums over those go
    range by range. A null score is left out.
    """
    points = written(
        df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(_positive(label)).alias("_pos"), F.count_if(~_positive(label)).alias("_neg")), "curve"
        # One group of all rows. Its key comes from the data, so joins on it stay equality joins.
    ).withColumns({"_all": F.col("_pos") < 0, "_down": -F.col("threshold")})
    sums = running(
        points, ["_all"], ["_down"],
        {"_tp": Agg("sum", F.col("_pos")), "_fp": Agg("sum", F.col("_neg"))}, max_rows=max_group_rows)
    total = points.agg(F.sum("_pos")).first()[0] or 0
    return (
        sums.withColumns({
            "tp": F.coalesce("_tp", F.lit(0)) + F.col("_pos"),
            "fp": F.coalesce("_fp", F.lit(0)) + F.col("_neg"),
            "_total": F.lit(total).cast("long"),
        })
        .select(
            "threshold", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
            (F.col("tp") / F.nullif(F.col("_total"), F.lit(0))).alias("recall"), "_pos", "_total",
        )
    )


def average_precision_of(curve: DataFrame) -> DataFrame:
    """Sum of precision weighted by the recall each distinct score adds."""
    gain = F.col("_pos") / F.nullif(F.col("_total"), F.lit(0))
    return curve.agg(F.sum(gain * F.col("precision")).alias("average_precision"))


def average_precision(df: DataFrame, score: str, label: str, **kw) -> DataFrame:
    return average_precision_of(pr_curve(df, score, label, **kw))


def fbeta_threshold_of(curve: DataFrame, beta: float = 2.0) -> DataFrame:
    """Score with the best F-beta; the lowest wins ties; 0.5 where no score has any."""
    p, r, b2 = F.col("precision"), F.col("recall"), float(beta) ** 2
    fbeta = F.when(p + r > 0, (1 + b2) * p * r / (b2 * p + r))
    best = curve.withColumn("fbeta", fbeta).filter("fbeta > 0").agg(
        F.max(F.struct("fbeta", (-F.col("threshold")).alias("_neg"))).alias("b"))
    return best.select(
        F.coalesce(-F.col("b._neg"), F.lit(0.5)).alias("threshold"), F.coalesce("b.fbeta", F.lit(0.0)).alias("fbeta"))


def fbeta_threshold(df: DataFrame, score: str, label: str, beta: float = 2.0, **kw) -> DataFrame:
    return fbeta_threshold_of(pr_curve(df, score, label, **kw), beta)


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    said, true = F.col(score) >= F.lit(float(threshold)), _positive(label)
    return df.agg(
        F.count_if(~said & ~true).alias("tn"), F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & true).alias("fn"), F.count_if(said & true).alias("tp"),
    )


def classification_report(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """Accuracy and the positive class's precision, recall, F1 and support; 0 where undefined."""
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(df, score, label, threshold).select(
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        (tp + fn).alias("support"),
    )


def bucket_rates(df: DataFrame, column: str, edges: list[float], names: list[str], label: str = "is_fraud") -> DataFrame:
    """Count and positive rate per right-closed bucket; the first also takes its lower edge.

    Every bucket is listed, also an empty one (rate null).
    """
    c = F.col(column).cast("double")
    bucket = F.when((c < edges[0]) | c.isNull(), None)
    for i, upper in enumerate(edges[1:]):
        bucket = bucket.when(c <= upper, i)
    bucket = bucket.otherwise(len(edges) - 1)
    stats = (
        df.select(bucket.alias("position"), _positive(label).cast("int").alias("_y")).filter("position IS NOT NULL")
        .groupBy("position").agg(F.count("*").alias("_n"), F.avg("_y").alias("fraud_rate"))
    )
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "position int, bucket string")
    return listed.join(stats, "position", "left").select(
        "position", "bucket", F.coalesce("_n", F.lit(0)).alias("transactions"), "fraud_rate")


def no_history_rates(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Count and positive rate of rows without history, and of the large ones among them."""
    cold = F.coalesce(F.col("user_historical_transaction_count"), F.lit(0)) == 0
    large = cold & (F.col("amount") >= S.LARGE_AMOUNT)
    y = _positive(label).cast("int")
    return df.agg(
        F.count_if(cold).alias("no_history"), F.avg(F.when(cold, y)).alias("no_history_rate"),
        F.count_if(large).alias("large_no_history"), F.avg(F.when(large, y)).alias("large_no_history_rate"),
    )
