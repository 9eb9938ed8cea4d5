"""Per-user trailing-window features: counts, amount, distinct merchants, recency.

A row sees the user's rows strictly before it in (second, transaction_id) order, window ends
included. The work is laid out so that no task depends on how many rows a user has:

* rows are added up per (user, second) with map-side combine;
* seconds are cut into hour buckets, each also copied to the next hour, so a bucket holds the full
  trailing hour of its seconds and at most 7,200 of them;
* a merchant's presence in an hour's windows follows from two numbers, its last second in the
  hour before and its first in the hour itself, so distinct counts are a running sum;
* rows sharing a second add the small remainder that earlier rows of that second contribute,
  chunked by `ordered.running` where a single second is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from riskflow import schemas as S
from riskflow.functions.scalar import epoch_seconds
from riskflow.operators.ordered import MAX_GROUP_ROWS, Agg, large_groups, running

_HOUR = S.ONE_HOUR
VELOCITY_COLUMNS = [
    "user_transaction_count_5min",
    "user_transaction_count_1hour",
    "amount_velocity_1hour",
    "distinct_merchant_count_1hour",
    "seconds_since_last_transaction",
]


def session_starts(rows: DataFrame, ttl_seconds: int) -> DataFrame:
    """(user_id, sec, session_start): a pause of ttl_seconds or more opens a new session."""
    in_hour = Window.partitionBy("user_id", "hour").orderBy("sec")
    up_to_here = in_hour.rowsBetween(Window.unboundedPreceding, 0)
    secs = (
        rows.select("user_id", "sec").distinct()
        .withColumn("hour", F.expr(f"sec div {_HOUR}"))
        .withColumn("_gap", F.col("sec") - F.lag("sec").over(in_hour))
        .withColumn("_start", F.when(F.col("_gap") >= ttl_seconds, F.col("sec")))
        .withColumn("_run", F.max("_start").over(up_to_here))
    )
    # One row per active hour; the first second of an hour is judged against the hour before.
    by_hour = Window.partitionBy("user_id").orderBy("hour")
    hours = (
        secs.groupBy("user_id", "hour")
        .agg(F.min("sec").alias("_first"), F.max("sec").alias("_last"), F.max("_start").alias("_inner"))
        .withColumn("_pause", F.col("_first") - F.lag("_last").over(by_hour))
        .withColumn("_opens", F.when(F.col("_pause").isNull() | (F.col("_pause") >= ttl_seconds), F.col("_first")))
        .withColumn("_latest", F.coalesce("_inner", "_opens"))
        .withColumn(
            "_carried",
            F.last("_latest", ignorenulls=True).over(by_hour.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("user_id", "hour", "_opens", "_carried")
    )
    return secs.join(hours, ["user_id", "hour"]).select(
        "user_id", "sec", F.coalesce("_run", "_opens", "_carried").alias("session_start")
    )


def _merchant_marks(copies: DataFrame, keys: list[str]) -> DataFrame:
    return copies.groupBy(*keys, "bucket", "merchant_id").agg(
        F.max(F.when(~F.col("own"), F.col("sec"))).alias("last_before"),
        F.min(F.when(F.col("own"), F.col("sec"))).alias("first_here"),
    )


def _merchant_steps(marks: DataFrame, keys: list[str]) -> DataFrame:
    """+1/-1 at the seconds where a merchant enters or leaves the trailing hour."""
    start = F.col("bucket") * _HOUR
    leaves = F.col("last_before") + _HOUR + 1
    enters = F.col("first_here") + 1
    step = lambda at, d: F.struct(at.alias("pos"), F.lit(d).alias("dm"))
    steps = (
        F.when(F.col("last_before").isNull(), F.array(step(enters, 1)))
        .when(F.col("first_here").isNull(), F.array(step(start, 1), step(leaves, -1)))
        .when(enters <= leaves, F.array(step(start, 1)))
        .otherwise(F.array(step(start, 1), step(leaves, -1), step(enters, 1)))
    )
    return marks.select(*keys, "bucket", F.explode(steps).alias("_s")).select(
        *keys, "bucket", F.col("_s.pos").alias("pos"), F.lit(0).cast("long").alias("n"),
        F.lit(0).cast(S.MONEY).alias("amt"), F.col("_s.dm").cast("long").alias("dm"), F.lit(False).alias("own"),
    )


def velocity_features(
    tx: DataFrame, *, ttl_seconds: int | None = None, max_group_rows: int = MAX_GROUP_ROWS,
    large_users: DataFrame | None | str = "measure",
) -> DataFrame:
    """transaction_id with the five velocity features.

    `ttl_seconds=None` is a true trailing hour; a number restarts the windows after that long a
    pause of the user. `large_users` takes a measurement of `tx` the caller already has. A row without
    user, merchant or time belongs to no window: it comes back with null features, and no other row
    sees it. Ids are expected to be unique; `validate.deduplicate` makes them so.
    """
    every = tx.select(
        "transaction_id", "user_id", "merchant_id", F.col("amount").cast(S.MONEY).alias("amount"),
        epoch_seconds(F.col("creation_date_time")).alias("sec"),
    )
    complete = F.col("user_id").isNotNull() & F.col("merchant_id").isNotNull() & F.col("sec").isNotNull()
    rows = every.filter(complete)
    large = _large_seconds(rows, large_users, max_group_rows)
    keys = ["user_id"]
    if ttl_seconds is not None:
        rows = rows.join(session_starts(rows, ttl_seconds), ["user_id", "sec"])
        keys = ["user_id", "session_start"]

    hour = F.expr(f"sec div {_HOUR}")
    copies = rows.select(
        *keys, "merchant_id", "amount", "sec", hour.alias("hour"), F.explode(F.array(hour, hour + 1)).alias("bucket")
    ).withColumn("own", F.col("bucket") == F.col("hour"))
    marks = _merchant_marks(copies, keys)

    points = (
        copies.select(
            *keys, "bucket", F.col("sec").alias("pos"), F.lit(1).cast("long").alias("n"),
            F.col("amount").alias("amt"), F.lit(0).cast("long").alias("dm"), "own",
        )
        .unionByName(_merchant_steps(marks, keys))
        .groupBy(*keys, "bucket", "pos")
        .agg(F.sum("n").alias("n"), F.sum("amt").alias("amt"), F.sum("dm").alias("dm"), F.max("own").alias("own"))
    )
    w = Window.partitionBy(*keys, "bucket").orderBy("pos")
    seconds = (
        points.select(
            *keys, "bucket", F.col("pos").alias("sec"), "n", "own",
            F.sum("n").over(w.rangeBetween(-S.FIVE_MINUTES, -1)).alias("n5"),
            F.sum("n").over(w.rangeBetween(-_HOUR, -1)).alias("n60"),
            F.sum("amt").over(w.rangeBetween(-_HOUR, -1)).alias("amt60"),
            F.sum("dm").over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("merchants"),
            F.max(F.when(F.col("n") > 0, F.col("pos"))).over(w.rangeBetween(Window.unboundedPreceding, -1)).alias("prev"),
        )
        .filter("own AND n > 0")
        .drop("own")
    )
    if ttl_seconds is None or ttl_seconds > _HOUR:
        # Beyond the bucket only the last second of the latest earlier active hour matters.
        by_hour = Window.partitionBy(*keys).orderBy("bucket")
        earlier = (
            rows.groupBy(*keys, hour.alias("bucket")).agg(F.max("sec").alias("_last"))
            .select(*keys, "bucket", F.lag("_last").over(by_hour).alias("_earlier"))
        )
        seconds = (
            seconds.join(earlier, [*keys, "bucket"])
            .withColumn("prev", F.coalesce("prev", "_earlier")).drop("_earlier")
        )

    # A row whose merchant was absent from the window until this second.
    rows = rows.withColumn("bucket", hour).join(marks, [*keys, "bucket", "merchant_id"]).select(
        "transaction_id", *keys, "sec", "merchant_id", "amount",
        (
            (F.col("first_here") == F.col("sec"))
            & (F.col("last_before").isNull() | (F.col("last_before") < F.col("sec") - _HOUR))
        ).alias("_candidate"),
    )
    # A session is settled by user and second, so these two alone group the rows of a second.
    out = _within_second(rows.join(seconds, [*keys, "sec"]), ["user_id", "sec"], large, max_group_rows)
    since = F.coalesce(F.col("sec") - F.col("prev"), F.lit(S.NO_PREVIOUS_SECONDS))
    found = out.select(
        "transaction_id",
        (F.coalesce("n5", F.lit(0)) + F.col("_rank")).alias("user_transaction_count_5min"),
        (F.coalesce("n60", F.lit(0)) + F.col("_rank")).alias("user_transaction_count_1hour"),
        (F.coalesce("amt60", F.lit(0)) + F.col("_amount")).cast("decimal(29,2)").alias("amount_velocity_1hour"),
        (F.col("merchants") + F.col("_new")).alias("distinct_merchant_count_1hour"),
        F.when(F.col("_rank") > 0, F.lit(0)).otherwise(since).cast("long").alias("seconds_since_last_transaction"),
    )
    apart = every.filter(~complete).select(
        "transaction_id", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in VELOCITY_COLUMNS])
    return found.union(apart)


def _large_seconds(rows: DataFrame, users: DataFrame | None | str, max_rows: int) -> DataFrame | None:
    """Seconds with more rows than a window task should take; looked for only below large users."""
    if isinstance(users, str):
        users = large_groups(rows.select("user_id"), ["user_id"], max_rows)
    if users is None:
        return None
    return large_groups(rows.join(F.broadcast(users), "user_id", "left_semi"), ["user_id", "sec"], max_rows)


def _within_second(rows: DataFrame, group: list[str], large: DataFrame | None, max_rows: int) -> DataFrame:
    """What the rows of the same second with a smaller id add: count, amount, new merchants."""
    order = ["transaction_id"]
    if large is None:
        first = F.row_number().over(Window.partitionBy(*group, "merchant_id").orderBy(*order)) == 1
        rows = rows.withColumn("_enters", (F.col("_candidate") & first).cast("long"))
    else:
        leaders = rows.filter("n > 1").groupBy(*group, "merchant_id").agg(F.min("transaction_id").alias("_leader"))
        rows = rows.join(leaders, [*group, "merchant_id"], "left").withColumn(
            "_enters", (F.col("_candidate") & (F.col("transaction_id") == F.col("_leader"))).cast("long"))
    out = running(
        rows, group, order,
        {"_rank": Agg("sum", F.lit(1)), "_amount": Agg("sum", F.col("amount").cast("decimal(19,2)")),
         "_new": Agg("sum", F.col("_enters"))},
        large=large, max_rows=max_rows,
    )
    return out.withColumns({
        "_rank": F.coalesce("_rank", F.lit(0)).cast("long"),
        "_amount": F.coalesce("_amount", F.lit(0).cast(S.MONEY)),
        "_new": F.coalesce("_new", F.lit(0)).cast("long"),
    })


def recent_entries(tx: DataFrame, now_seconds: int) -> DataFrame:
    """The entries a cleanup at `now` keeps: those younger than one hour."""
    return tx.filter(epoch_seconds(F.col("creation_date_time")) > now_seconds - _HOUR)
