"""Model registry: latest release, release in force at an event's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from riskflow import schemas as S
from riskflow.functions.scalar import epoch_seconds
from riskflow.operators.ordered import Agg, running


def model_objects(releases: DataFrame, prefix: str = S.MODEL_PREFIX) -> DataFrame:
    return releases.filter(F.startswith("object_name", F.lit(prefix)))


def latest_model(releases: DataFrame, prefix: str = S.MODEL_PREFIX) -> DataFrame:
    """One row: the newest object whose name has the model prefix; names break ties."""
    newest = F.max(F.struct("released_at", "object_name")).alias("_r")
    return model_objects(releases, prefix).agg(newest).filter("_r IS NOT NULL").select("_r.object_name", "_r.released_at")


def model_in_force(
    events: DataFrame, releases: DataFrame, ts: str = "creation_date_time", event_id: str = "transaction_id",
    *, small_registry: int = 2_000,
) -> DataFrame:
    """Adds `model_version`: the release each event was scored under; null before the first.

    A registry of at most `small_registry` rows (counted here) is joined by day without moving the
    events; a larger one is merged with the events of each day in time order.
    """
    objects = model_objects(releases).select("object_name", "released_at")
    if objects.limit(small_registry + 1).count() <= small_registry:
        return _by_release_days(events, objects, ts)
    return _by_time_sweep(events, objects, ts, event_id)


def _by_release_days(events: DataFrame, objects: DataFrame, ts: str) -> DataFrame:
    """Each release's span, cut at day borders, meets the events of its day."""
    by_time = Window.partitionBy(F.lit(0)).orderBy("released_at", "object_name")
    spans = objects.withColumn("_until", F.lead("released_at").over(by_time))
    first, last = events.agg(F.min(F.to_date(ts)), F.max(F.to_date(ts))).first()
    day_from = F.greatest(F.to_date("released_at"), F.lit(first))
    day_to = F.least(F.coalesce(F.to_date("_until"), F.lit(last)), F.lit(last))
    daily = spans.filter(day_from <= day_to).withColumn("_day", F.explode(F.sequence(day_from, day_to)))
    inside = (F.col(ts) >= F.col("released_at")) & (F.col("_until").isNull() | (F.col(ts) < F.col("_until")))
    # At most one row per release and day: the registry was counted as small.
    return (
        events.withColumn("_event_day", F.to_date(ts))
        .join(F.broadcast(daily), (F.col("_event_day") == F.col("_day")) & inside, "left")
        .withColumn("model_version", F.col("object_name"))
        .drop("object_name", "released_at", "_until", "_day", "_event_day")
    )


def _by_time_sweep(events: DataFrame, objects: DataFrame, ts: str, event_id: str) -> DataFrame:
    """Releases sort into the events of their day ahead of those of the same instant; the latest one before an
    event is the running maximum of (time, name). A day begins with the last release of the days before,
    so days are groups of their own and no order spans the table."""
    columns = events.columns
    # The last release of each release day opens the days up to and with the next release day: one row a day.
    latest = objects.filter("released_at IS NOT NULL").groupBy(F.to_date("released_at").alias("_from")).agg(
        F.max(F.struct("released_at", "object_name")).alias("_last"))
    next_day = F.lead("_from").over(Window.partitionBy(F.lit(0)).orderBy("_from"))
    first, last = events.agg(F.min(F.to_date(ts)), F.max(F.to_date(ts))).first()
    day_from = F.greatest(F.date_add("_from", 1), F.lit(first))
    day_to = F.least(F.coalesce(next_day, F.lit(last)), F.lit(last))
    opening = latest.withColumns({"_a": day_from, "_b": day_to}).filter("_a <= _b").select(
        F.explode(F.sequence("_a", "_b")).alias("_day"), "_last.released_at", "_last.object_name")
    opening = opening.select("_day", F.col("_day").cast("timestamp_ntz").alias("_at"), F.lit(-1).alias("_kind"),
                             F.col("object_name").alias("_id"), F.struct(F.col("released_at").alias("_at"), F.col("object_name").alias("_id")).alias("_release"))
    marked = events.select(F.to_date(ts).alias("_day"), F.col(ts).cast("timestamp_ntz").alias("_at"), F.lit(1).alias("_kind"),
                           F.col(event_id).alias("_id"), F.struct(*columns).alias("_event"))
    own = objects.filter("released_at IS NOT NULL").select(
        F.to_date("released_at").alias("_day"), F.col("released_at").cast("timestamp_ntz").alias("_at"), F.lit(0).alias("_kind"),
        F.col("object_name").alias("_id"), F.struct(F.col("released_at").alias("_at"), F.col("object_name").alias("_id")).alias("_release"))
    stream = marked.unionByName(own.unionByName(opening), allowMissingColumns=True)
    out = running(stream, ["_day"], ["_at", "_kind", "_id"], {"_r": Agg("max", F.col("_release"))})
    return out.filter("_kind = 1").select("_event.*", F.col("_r._id").alias("model_version"))


def release_events(releases: DataFrame, bucket: str = "models") -> DataFrame:
    """Release messages: object_name, bucket, timestamp in epoch seconds."""
    return releases.select("object_name", F.lit(bucket).alias("bucket"), epoch_seconds(F.col("released_at")).alias("timestamp"))
