"""History features: whole-table averages and their point-in-time forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskflow import schemas as S
from riskflow.functions.scalar import epoch_seconds, is_blank
from riskflow.operators.ordered import MAX_GROUP_ROWS, Agg, large_groups, running


def with_predictions(tx: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every transaction with its prediction, if there is one."""
    return tx.join(predictions, "transaction_id", "left")


def scored_transactions(tx: DataFrame, vectors: DataFrame, predictions: DataFrame) -> DataFrame:
    """Transaction, feature vector and prediction joined one to one on the id."""
    clash = [c for c in vectors.columns if c in tx.columns and c != "transaction_id"]
    return tx.join(vectors.drop(*clash), "transaction_id").join(predictions, "transaction_id")


def risk_points(level: Column) -> Column:
    return F.when(level == "HIGH", 1.0).when(level == "MEDIUM", 0.5).otherwise(0.0)


def user_averages(tx: DataFrame, predictions: DataFrame) -> DataFrame:
    """Average amount per user over transactions marked safe; 0 where none is."""
    safe = F.when(F.col("is_marked_as_safe"), F.col("amount"))
    return (
        with_predictions(tx.select("transaction_id", "user_id", "amount"),
                         predictions.select("transaction_id", "is_marked_as_safe"))
        .groupBy("user_id")
        .agg(F.sum(safe).alias("_s"), F.count(safe).alias("_n"))
        .select("user_id", F.when(F.col("_n") > 0, F.col("_s").cast("double") / F.col("_n")).otherwise(0.0)
                .alias("average_amount"))
    )


def user_counts(tx: DataFrame) -> DataFrame:
    return tx.groupBy("user_id").agg(F.count("*").alias("transaction_count"))


def ip_risk(tx: DataFrame, predictions: DataFrame) -> DataFrame:
    """Share of risky transactions per address: HIGH counts 1, MEDIUM one half."""
    return (
        with_predictions(tx.select("transaction_id", "ip_address").filter(~is_blank(F.col("ip_address"))),
                         predictions.select("transaction_id", "risk_level"))
        .groupBy("ip_address")
        .agg((F.sum(risk_points(F.col("risk_level"))) / F.count("*")).alias("ip_risk_score"))
    )


def _keyed() -> Column:
    """A row has a user and a time; one without belongs to no history, its own or another's."""
    return ~is_blank(F.col("user_id")) & F.col("sec").isNotNull()


def _apart(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found, and the rows without user or time with nulls in its further columns."""
    return found.union(rows.filter(~_keyed()).select(
        "transaction_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields[1:]]))


def user_history(
    tx: DataFrame, predictions: DataFrame | None, *, safe_only: bool = False,
    cold_start: float = S.COLD_START_AVERAGE, max_group_rows: int = MAX_GROUP_ROWS,
    large_users: DataFrame | None | str = "measure",
) -> DataFrame:
    """transaction_id with the user's average amount and count over strictly earlier rows.

    `safe_only` averages rows whose prediction is marked safe; the count always takes all rows. A row without
    user or time is in no history: it comes back with nulls.
    """
    if isinstance(large_users, str):
        large_users = large_groups(tx, ["user_id"], max_group_rows)
    every = tx.select("transaction_id", "user_id", "amount", epoch_seconds(F.col("creation_date_time")).alias("sec"))
    rows = every.filter(_keyed())
    if safe_only:
        rows = with_predictions(rows, predictions.select("transaction_id", F.col("is_marked_as_safe").alias("_safe")))
    else:
        rows = rows.withColumn("_safe", F.lit(True))
    counted = F.when(F.col("_safe"), F.col("amount"))
    out = running(
        rows, ["user_id"], ["sec", "transaction_id"],
        {
            "_all": Agg("sum", F.lit(1)),
            "_sum": Agg("sum", counted),
            "_n": Agg("sum", F.when(F.col("_safe"), 1)),
        },
        large=large_users, max_rows=max_group_rows,
    )
    average = F.col("_sum").cast("double") / F.col("_n")
    return _apart(every, out.select(
        "transaction_id",
        F.when(average > 0, average).otherwise(F.lit(float(cold_start))).alias("user_average_amount"),
        F.coalesce("_all", F.lit(0)).cast("long").alias("user_historical_transaction_count"),
    ))


def ip_history(tx: DataFrame, predictions: DataFrame, *, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """transaction_id with the address risk over strictly earlier rows of that address.

    Rows without an address or a time are not here: their risk is 0 and they need no shuffle.
    """
    addressed = tx.filter(~is_blank(F.col("ip_address")) & F.col("creation_date_time").isNotNull()).select(
        "transaction_id", "ip_address", epoch_seconds(F.col("creation_date_time")).alias("sec"))
    large = large_groups(addressed, ["ip_address"], max_group_rows)
    rows = with_predictions(addressed, predictions.select("transaction_id", "risk_level"))
    out = running(
        rows, ["ip_address"], ["sec", "transaction_id"],
        {"_n": Agg("sum", F.lit(1)), "_points": Agg("sum", risk_points(F.col("risk_level")))},
        large=large, max_rows=max_group_rows,
    )
    return out.select("transaction_id", F.coalesce(F.col("_points") / F.col("_n"), F.lit(0.0)).alias("ip_risk_score"))


def address_key() -> Column:
    """The address, or where it or the time is missing a key of the row's own."""
    missing = is_blank(F.col("ip_address")) | F.col("creation_date_time").isNull()
    return F.when(missing, F.concat(F.lit("-"), F.col("transaction_id"))).otherwise(F.concat(F.lit("+"), F.col("ip_address")))


def with_address_risk(rows: DataFrame, large: DataFrame | None, *, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """rows, which hold `_address` (see `address_key`) and risk_level, with the risk `ip_history` gives; 0 without one.

    `large` is the measurement of `_address` by `large_groups`.
    """
    out = running(
        rows.withColumn("_sec", epoch_seconds(F.col("creation_date_time"))), ["_address"], ["_sec", "transaction_id"],
        {"_n": Agg("sum", F.lit(1)), "_points": Agg("sum", risk_points(F.col("risk_level")))},
        large=large, max_rows=max_group_rows,
    )
    return out.select(*rows.columns, F.coalesce(F.col("_points") / F.col("_n"), F.lit(0.0)).alias("ip_risk_score"))


def previous_transaction(tx: DataFrame, *, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """transaction_id with the id and time of the user's latest earlier row; nulls for a row without user or time."""
    rows = tx.select("transaction_id", "user_id", epoch_seconds(F.col("creation_date_time")).alias("sec"))
    here = F.struct("sec", "transaction_id")
    out = running(rows.filter(_keyed()), ["user_id"], ["sec", "transaction_id"], {"_prev": Agg("max", here)}, max_rows=max_group_rows)
    return _apart(rows, out.select(
        "transaction_id",
        F.col("_prev.transaction_id").alias("previous_transaction_id"),
        (F.col("sec") - F.col("_prev.sec")).alias("seconds_since_previous"),
    ))
