"""Training-set checks: class overlap, single-feature leakage, summary, clipping, fault injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskflow import schemas as S
from riskflow.functions.scalar import hashed_uniform
from riskflow.operators.ordered import MAX_GROUP_ROWS, Agg, running, written
from riskflow.operators.quantiles import exact_quantiles

# --- fixed values: columns of each report ------------------------------------------------------
CONTINUOUS_OVERLAP = [
    "amount", "user_average_amount", "merchant_risk_score", "ip_risk_score",
    "amount_to_average_ratio", "card_age_days", "seconds_since_last_transaction",
    "user_historical_transaction_count",
]
CATEGORICAL_OVERLAP = ["is_device_trusted", "has_country_mismatch", "hour_of_day"]
AUC_FEATURES = [f for f in S.BASE_FEATURES if f not in ("merchant_category", "card_type")]
PLOT_FEATURES = [
    "amount", "merchant_risk_score", "ip_risk_score", "amount_to_average_ratio",
    "user_historical_transaction_count", "seconds_since_last_transaction",
    "is_device_trusted", "has_country_mismatch",
]
NON_NEGATIVE = ["amount", "user_average_amount", "amount_velocity_1hour", "card_age_days", "seconds_since_last_transaction"]
UNIT_RANGE = ["merchant_risk_score", "ip_risk_score"]
NOISY = ["amount", "user_average_amount", "merchant_risk_score", "ip_risk_score",
         "amount_to_average_ratio", "amount_velocity_1hour"]
BLANKABLE = NOISY + [
    "user_transaction_count_5min", "user_transaction_count_1hour", "seconds_since_last_transaction",
    "card_age_days", "user_account_age_days", "user_historical_transaction_count",
]
MISSING_RATE, OUTLIER_RATE, NOISE_SCALE = 0.01, 0.002, 0.01
MIN_VALID = 100


def long_form(df: DataFrame, columns: list[str], label: str, numbered: bool = False) -> DataFrame:
    """(feature, value, positive) without nulls and NaN: all columns in one pass over the rows. `numbered`: a feature is
    its place among the columns, a fixed four bytes where rows of many values move."""
    pairs = F.array(*[F.struct(F.lit(i if numbered else c).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    return (
        df.select(F.col(label).cast("boolean").alias("positive"), F.explode(pairs).alias("_p"))
        .select("_p.feature", "_p.value", "positive").filter("value IS NOT NULL AND NOT isnan(value)")
    )


def _for_every(columns: list[str], found: DataFrame, name: str, otherwise: float) -> DataFrame:
    """A row for each requested feature: one without any value gets `otherwise`."""
    asked = found.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return asked.join(F.broadcast(found), "feature", "left").select("feature", F.coalesce(name, F.lit(otherwise)).alias(name))


def class_histograms(df: DataFrame, columns: list[str], label: str = "is_fraud", bins: int = 50) -> DataFrame:
    """feature, bin, lower, upper, fraud and legit counts and densities, on equal-width bins over
    the pooled range. Only bins holding rows are listed."""
    rows = long_form(df, columns, label)
    ranges = rows.groupBy("feature").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        F.count_if("positive").alias("_p"), F.count_if(~F.col("positive")).alias("_l"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0)
    index = F.when(
        F.col("_hi") > F.col("_lo"),
        F.least(F.floor((F.col("value") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1)),
    ).otherwise(0).cast("int")
    density = lambda n, total: F.coalesce(n / (F.nullif(total, F.lit(0)) * F.col("_w")), F.lit(0.0))
    # One row per feature: the ranges always broadcast.
    return (
        rows.join(F.broadcast(ranges), "feature")
        .groupBy("feature", index.alias("bin"), "_lo", "_p", "_l", width.alias("_w"))
        .agg(F.count_if("positive").alias("fraud"), F.count_if(~F.col("positive")).alias("legit"))
        .select(
            "feature", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lower"),
            (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("upper"), "fraud", "legit",
            density(F.col("fraud"), F.col("_p")).alias("fraud_density"),
            density(F.col("legit"), F.col("_l")).alias("legit_density"),
            "_p", "_l",
        )
    )


def _shared_mass(binned: DataFrame) -> DataFrame:
    share = F.least(F.col("fraud") / F.nullif(F.col("_p"), F.lit(0)), F.col("legit") / F.nullif(F.col("_l"), F.lit(0)))
    both = (F.col("_p") > 0) & (F.col("_l") > 0)
    return binned.groupBy("feature").agg(
        F.round(F.least(F.lit(1.0), F.sum(F.when(both, share).otherwise(0.0))), 4).alias("overlap"))


def overlap(df: DataFrame, columns: list[str] = CONTINUOUS_OVERLAP, label: str = "is_fraud", bins: int = 50) -> DataFrame:
    """Shared mass of the two class distributions per continuous column."""
    return _for_every(columns, _shared_mass(class_histograms(df, columns, label, bins)), "overlap", 0.0)


def categorical_overlap(df: DataFrame, columns: list[str] = CATEGORICAL_OVERLAP, label: str = "is_fraud") -> DataFrame:
    """Shared mass per categorical column; a value one class lacks adds nothing."""
    rows = long_form(df, columns, label)
    totals = rows.groupBy("feature").agg(
        F.count_if("positive").alias("_p"), F.count_if(~F.col("positive")).alias("_l"))
    counts = rows.groupBy("feature", "value").agg(
        F.count_if("positive").alias("fraud"), F.count_if(~F.col("positive")).alias("legit"))
    return _for_every(columns, _shared_mass(counts.join(F.broadcast(totals), "feature")), "overlap", 0.0)


def overlap_report(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    return overlap(df, label=label).unionByName(categorical_overlap(df, label=label))


def single_feature_auc(df: DataFrame, columns: list[str] = AUC_FEATURES, label: str = "is_fraud", *,
                       max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """feature, auc: rank AUC with ties, folded above one half; 0.5 below 100 valid values.

    Rows collapse to distinct values, which are written: they are measured first and read twice where a
    feature is large. The running sums over them are chunked, since a continuous feature may have as many values as rows.
    """
    values = written(
        long_form(df, columns, label, numbered=True).groupBy("feature", "value")
        .agg(F.count_if("positive").alias("_pos"), F.count_if(~F.col("positive")).alias("_neg")), "values")
    below = running(values, ["feature"], ["value"], {"_below": Agg("sum", F.col("_neg"))}, max_rows=max_group_rows)
    wins = F.col("_pos") * (F.coalesce("_below", F.lit(0)) + F.col("_neg") / 2)
    auc = F.col("_w") / (F.col("_p").cast("double") * F.col("_n"))
    found = (
        below.groupBy("feature").agg(F.sum(wins).alias("_w"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
        .select(
            F.array(*[F.lit(c) for c in columns])[F.col("feature")].alias("feature"),
            F.when((F.col("_p") + F.col("_n") < MIN_VALID) | (F.col("_p") == 0) | (F.col("_n") == 0), 0.5)
            .otherwise(F.round(F.greatest(auc, 1 - auc), 4)).alias("auc"),
        )
    )
    return _for_every(columns, found, "auc", 0.5)


def top_aucs(df: DataFrame, n: int = 10, **kw) -> DataFrame:
    return single_feature_auc(df, **kw).orderBy(F.desc("auc"), "feature").limit(n)


def dataset_summary(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """One row of counts, rates, mean overlap, largest AUC and the cold-start lift."""
    y = F.col(label).cast("boolean")
    cold = (F.col("amount") >= S.LARGE_AMOUNT) & (F.coalesce("user_historical_transaction_count", F.lit(0)) == 0)
    counts = df.agg(
        F.count("*").alias("total_rows"), F.count_if(y).alias("fraud_count"),
        F.avg(y.cast("int")).alias("_rate"), F.count_if(cold).alias("large_cold_start_count"),
        F.avg(F.when(cold, y.cast("int"))).alias("_cold"),
    )
    overlaps = overlap_report(df, label).agg(F.round(F.avg("overlap"), 4).alias("avg_overlap"))
    aucs = single_feature_auc(df, label=label).agg(F.max("auc").alias("max_single_feature_auc"))
    rate, cold_rate = F.coalesce("_rate", F.lit(0.0)), F.coalesce("_cold", F.lit(0.0))
    # Three one-row results, each with its own columns, brought into one row.
    parts = counts.unionByName(overlaps, allowMissingColumns=True).unionByName(aucs, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns]).select(
        "total_rows", "fraud_count", (F.col("total_rows") - F.col("fraud_count")).alias("legit_count"),
        F.round(rate, 4).alias("fraud_rate"), "avg_overlap", "max_single_feature_auc", "large_cold_start_count",
        F.round(cold_rate, 4).alias("large_cold_start_fraud_rate"),
        F.round(cold_rate / F.greatest(rate, F.lit(0.0001)), 2).alias("large_cold_start_lift"),
    )


def acceptance(summary: DataFrame) -> DataFrame:
    """Whether a summary meets the three acceptance bounds."""
    return summary.select(
        (F.col("avg_overlap") >= S.MIN_MEAN_OVERLAP).alias("overlap_ok"),
        (F.col("max_single_feature_auc") <= S.MAX_FEATURE_AUC).alias("leakage_ok"),
        (F.col("large_cold_start_lift") >= S.MIN_COLD_LIFT).alias("cold_start_ok"),
    )


def clip_ranges(df: DataFrame) -> DataFrame:
    """Bounds the columns with a natural range; nulls stay null."""
    def clip(name: str, upper: float | None) -> Column:
        c = F.col(name).cast("double")
        top = F.least(c, F.lit(upper)) if upper is not None else c
        return F.when(c.isNotNull(), F.greatest(top, F.lit(0.0)))

    cols = {n: clip(n, None) for n in NON_NEGATIVE if n in df.columns}
    return df.withColumns({**cols, **{n: clip(n, 1.0) for n in UNIT_RANGE if n in df.columns}})


def inject_faults(df: DataFrame, seed: int = 42, *, missing_rate: float = MISSING_RATE,
                  outlier_rate: float = OUTLIER_RATE, noise_scale: float = NOISE_SCALE) -> DataFrame:
    """Blanks, outliers around the median and multiplicative noise for robustness tests.

    Draws come from a hash of the row id, the column and the seed, so reruns agree.
    """
    def draw(name: str, salt: str) -> Column:
        return hashed_uniform(seed, F.col("transaction_id"), F.lit(name), F.lit(salt))

    blanked = df.withColumns({
        n: F.when(draw(n, "missing") >= missing_rate, F.col(n).cast("double")) for n in BLANKABLE if n in df.columns})
    present = [n for n in NOISY if n in df.columns]
    medians = exact_quantiles(blanked, dict.fromkeys(present, 0.5))
    spiked = blanked.withColumns({
        n: F.when(draw(n, "outlier") < outlier_rate, F.lit(medians[n]) * (0.1 + 7.9 * draw(n, "size"))).otherwise(F.col(n))
        for n in present})

    def normal(name: str) -> Column:
        u = F.greatest(draw(name, "u"), F.lit(1e-12))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * draw(name, "v"))

    noisy = spiked.withColumns({n: F.col(n) * (1 + normal(n) * noise_scale) for n in present})
    return clip_ranges(noisy)


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """All rows in a repeatable random order (a range sort on a hash, spread over all tasks)."""
    return df.withColumn("_o", F.xxhash64("transaction_id", F.lit(seed))).orderBy("_o", "transaction_id").drop("_o")
