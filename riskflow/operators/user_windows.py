"""All features that look back over a user's rows, on one layout.

`velocity` and `history` each shuffle for themselves and cut users by the hour, which a user of any size needs. Most
tables have no such user. Here the rows of users up to `max_group_rows` move once, by user, and every window below is
answered on that layout: windows by session or merchant lie inside a user, so they sort but don't shuffle. Only rows of
larger users take the two operators.

A count, amount or number of merchants over the trailing hour is a difference of two running sums, one up to the row
and one up to the window's start, so a row costs the same however full its hour is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskflow import schemas as S
from riskflow.functions.scalar import epoch_seconds, is_blank
from riskflow.operators.history import user_history
from riskflow.operators.ordered import MAX_GROUP_ROWS, large_groups, written
from riskflow.operators.velocity import VELOCITY_COLUMNS, velocity_features

HISTORY_COLUMNS = ["user_average_amount", "user_historical_transaction_count"]
USER_COLUMNS = [*VELOCITY_COLUMNS, *HISTORY_COLUMNS]
# A user's rows; one without user or time is a group of its own.
_GROUP = ["user_id", "_alone"]


def user_features(
    rows: DataFrame, *, ttl_seconds: int | None = None, safe_only: bool = False,
    cold_start: float = S.COLD_START_AVERAGE, max_group_rows: int = MAX_GROUP_ROWS,
    large_users: DataFrame | None | str = "measure",
) -> DataFrame:
    """rows with the columns of `velocity_features` and `user_history`, equal to theirs.

    `rows` holds transaction_id, user_id, merchant_id, amount, creation_date_time and, for `safe_only`,
    is_marked_as_safe; further columns are carried along. `large_users` takes a measurement the caller has.
    A row without user, merchant or time has null velocity, one without user (null or blank) or time null
    history, and neither is seen by others. Ids are expected to be unique.
    """
    if isinstance(large_users, str):
        large_users = large_groups(rows, ["user_id"], max_group_rows)
    modes = dict(ttl_seconds=ttl_seconds, safe_only=safe_only, cold_start=cold_start)
    if large_users is None:
        return _on_one_layout(rows, **modes)
    # Users without an id match nothing here: their rows stand alone in the other branch.
    marked = rows.join(F.broadcast(large_users.select("user_id", F.lit(True).alias("_large"))), "user_id", "left")
    small = _on_one_layout(marked.filter("_large IS NULL").select(*rows.columns), **modes)
    big = written(marked.filter("_large").select(*rows.columns), "large-users")
    sizes = dict(max_group_rows=max_group_rows, large_users=large_users)
    marks = big.select("transaction_id", "is_marked_as_safe") if safe_only else None
    return small.unionByName(
        big.join(velocity_features(big, ttl_seconds=ttl_seconds, **sizes), "transaction_id")
        .join(user_history(big, marks, safe_only=safe_only, cold_start=cold_start, **sizes), "transaction_id")
        .select(*rows.columns, *USER_COLUMNS)
    )


def _on_one_layout(rows: DataFrame, *, ttl_seconds: int | None, safe_only: bool, cold_start: float) -> DataFrame:
    sec = epoch_seconds(F.col("creation_date_time"))
    keyed = rows.withColumn("sec", sec).withColumn(
        "_alone", F.when(F.col("user_id").isNull() | F.col("sec").isNull(), F.col("transaction_id")))
    # Stated, since the windows by session and merchant would otherwise each ask for their own keys.
    laid = keyed.repartition(*_GROUP).withColumn("_complete", F.col("_alone").isNull() & F.col("merchant_id").isNotNull())
    since = F.col("sec") - F.col("_prev")
    if ttl_seconds is None:
        # Merchants first: what follows then lies in one order, and rows are sorted twice, not three times.
        session = _GROUP
        turns = _past(_merchant_turns(laid, session), safe_only)
    else:
        past = _past(laid, safe_only)
        opens = F.col("_complete") & (F.col("_prev").isNull() | (since >= ttl_seconds))
        here = Window.partitionBy(*_GROUP).orderBy("sec", "transaction_id").rowsBetween(Window.unboundedPreceding, 0)
        past = past.withColumn("_session", F.max(F.when(opens, F.col("sec"))).over(here))
        # The first row of a session has nothing before it.
        past = past.withColumn("_prev", F.when(F.col("_prev") >= F.col("_session"), F.col("_prev")))
        session = [*_GROUP, "_session"]
        turns = _merchant_turns(past, session)
    counted = _trailing(turns, session)
    average = F.col("_sum").cast("double") / F.col("_n")
    known = F.col("_alone").isNull() & ~is_blank(F.col("user_id"))
    values = {
        "user_transaction_count_5min": F.col("_n5").cast("long"),
        "user_transaction_count_1hour": F.col("_n60").cast("long"),
        "amount_velocity_1hour": F.col("_amount60").cast("decimal(29,2)"),
        "distinct_merchant_count_1hour": F.col("_merchants").cast("long"),
        "seconds_since_last_transaction": F.coalesce(since, F.lit(S.NO_PREVIOUS_SECONDS)).cast("long"),
    }
    return counted.select(
        *rows.columns,
        *[F.when(F.col("_complete"), v).alias(n) for n, v in values.items()],
        F.when(known, F.when(average > 0, average).otherwise(F.lit(float(cold_start)))).alias("user_average_amount"),
        F.when(known, F.coalesce("_all", F.lit(0)).cast("long")).alias("user_historical_transaction_count"),
    )


def _past(laid: DataFrame, safe_only: bool) -> DataFrame:
    """The sums of all earlier rows and the second of the last complete one."""
    before = Window.partitionBy(*_GROUP).orderBy("sec", "transaction_id").rowsBetween(Window.unboundedPreceding, -1)
    safe = F.col("is_marked_as_safe") if safe_only else F.lit(True)
    return laid.select(
        "*",
        F.sum(F.lit(1)).over(before).alias("_all"),
        F.sum(F.when(safe, F.col("amount"))).over(before).alias("_sum"),
        F.sum(F.when(safe, 1)).over(before).alias("_n"),
        F.max(F.when(F.col("_complete"), F.col("sec"))).over(before).alias("_prev"),
    )


def _merchant_turns(laid: DataFrame, session: list[str]) -> DataFrame:
    """Marks the rows at which a merchant comes into the trailing hour, and those after which it leaves."""
    visits = Window.partitionBy(*session, "merchant_id").orderBy("sec", "transaction_id")
    pause = lambda other: other.isNull() | (F.abs(other - F.col("sec")) > S.ONE_HOUR)
    return laid.select(
        "*",
        pause(F.lag("sec").over(visits)).alias("_comes"),
        pause(F.lead("sec").over(visits)).alias("_goes"),
    )


def _trailing(marked: DataFrame, session: list[str]) -> DataFrame:
    """Counts, amount and merchants of the trailing windows, each up to the row less up to the window's start."""
    before = Window.partitionBy(*session).orderBy("sec", "transaction_id").rowsBetween(Window.unboundedPreceding, -1)
    by_second = Window.partitionBy(*session).orderBy("sec")
    hour = by_second.rangeBetween(Window.unboundedPreceding, -S.ONE_HOUR - 1)
    five = by_second.rangeBetween(Window.unboundedPreceding, -S.FIVE_MINUTES - 1)
    one = F.when(F.col("_complete"), 1)
    amount = F.when(F.col("_complete"), F.col("amount").cast(S.MONEY))
    comes = F.when(F.col("_complete") & F.col("_comes"), 1)
    goes = F.when(F.col("_complete") & F.col("_goes"), 1)
    up_to = marked.select(
        "*", _sum(one, before).alias("_b"), _sum(amount, before).alias("_ba"), _sum(comes, before).alias("_bm"))
    return up_to.select(
        *marked.columns,
        (F.col("_b") - _sum(one, five)).alias("_n5"),
        (F.col("_b") - _sum(one, hour)).alias("_n60"),
        (F.col("_ba") - _sum(amount, hour)).alias("_amount60"),
        (F.col("_bm") - _sum(goes, hour)).alias("_merchants"),
    )


def _sum(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0))
