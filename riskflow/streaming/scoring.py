"""The scoring stream: validate, compute features, score, explain, persist, publish, enqueue alerts.

Each micro-batch runs the batch operators over its rows plus the rows of the last hour, which the
previous batches left by event hour. Replaying a table through the stream so gives the features the batch
operators give, and no per-user state sits in a single Python task. Histories that reach back
further (counts, safe averages, address risk, last seen) are totals a key, in buckets (see state.py).

Address risk and safe averages read the predictions persisted before the batch began. Rows that come later than
the allowed lateness go to `late`; `replay_late` gives them, and the rows they would have changed, their features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from riskflow import schemas as S
from riskflow.functions.scalar import amount_to_average_ratio, epoch_seconds, hour_of_day, is_blank, iso_weekday, whole_days
from riskflow.ml.contributions import explain
from riskflow.ml.training import Bundle, score
from riskflow.operators import outbox, validate
from riskflow.operators.enrich import enrich
from riskflow.operators.history import risk_points
from riskflow.operators.messages import parsed, scored_records
from riskflow.operators.ordered import Agg, running
from riskflow.operators.user_windows import HISTORY_COLUMNS, user_features
from riskflow.operators.velocity import VELOCITY_COLUMNS, velocity_features
from riskflow.plans.feature_vector import Dimensions, engineer_features
from riskflow.streaming.state import Buckets, KeyedTotals, RecentRows
from riskflow.streaming.store import BatchStore, Progress

LATENESS_SECONDS = 600
TOPIC_CREATED = "transactions.created"

_USER_TOTALS = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("safe_n", T.LongType()),
    T.StructField("safe_amount", T.DecimalType(29, 2)), T.StructField("last_sec", T.LongType()),
])
_IP_TOTALS = T.StructType([
    T.StructField("ip_address", T.StringType()), T.StructField("n", T.LongType()), T.StructField("points", T.DoubleType()),
])
_RECENT = T.StructType([*S.TRANSACTION_SCHEMA.fields, T.StructField("sec", T.LongType())])


@dataclass
class ScoringStream:
    """Settings of the stream; `model` gives the bundle in force at the start of each batch, `releases` those in force
    between two event seconds: then each row is scored by the one of its own time."""

    store: BatchStore
    dims: Dimensions
    model: Callable[[], Bundle] | None
    ttl_seconds: int | None = S.SESSION_TTL_SECONDS
    safe_only: bool = True
    mark_safe: Column | None = None
    now: Column | None = None
    lateness_seconds: int = LATENESS_SECONDS
    #: A transaction of an unknown device is a dead letter; if false it is scored as untrusted.
    refuse_unknown_devices: bool = True
    releases: Callable[[int, int], list[tuple[int, Bundle]]] | None = None

    def __post_init__(self) -> None:
        self.users = KeyedTotals(self.store, "user_totals", "user_id", _USER_TOTALS, ("last_sec",))
        self.addresses = KeyedTotals(self.store, "ip_totals", "ip_address", _IP_TOTALS)
        self.rows = RecentRows(self.store, _RECENT)

    # ---- state ----
    def _horizon(self, high_water: int | None) -> int | None:
        """First second that a row which isn't late can look back to."""
        return None if high_water is None else high_water - self.lateness_seconds - S.ONE_HOUR

    def recent(self, progress: Progress) -> DataFrame:
        """Rows of earlier batches that new rows can look back to."""
        return self.rows.read(progress.hours, self._horizon(progress.high_water))

    def totals(self, kept: KeyedTotals, progress: Progress, keys: DataFrame) -> DataFrame:
        """Totals of the given keys over the batches before. last_sec: of the rows before those at hand."""
        return kept.lookup(Buckets(**progress.totals.get(kept.name, {})), keys)

    # ---- one batch ----
    def accept(self, messages: DataFrame, batch: int, progress: Progress) -> tuple[DataFrame, DataFrame]:
        """(new transactions of the batch, recent ones before it); the rest goes to side tables."""
        store = self.store
        now = self.now if self.now is not None else F.localtimestamp()
        columns = S.TRANSACTION_SCHEMA.names
        # The source is read once: everything below works on the written intake.
        violations = validate.transaction_violations(now, require_id=True)
        reason = (
            F.when(~F.col("readable"), "unreadable record")
            .when(F.size(violations) > 0, validate.violation_message(violations))
        )
        intake = store.write(parsed(messages).select(*columns, "record", reason.alias("reason")), "intake", batch)

        d = self.dims
        valid = validate.deduplicate(intake.filter("reason IS NULL").select(*columns))
        checked = validate.check_references(valid, d.users, d.merchants, d.cards, d.devices if self.refuse_unknown_devices else None)
        limit = None if progress.high_water is None else progress.high_water - self.lateness_seconds
        checked = store.write(
            checked.withColumn("sec", epoch_seconds(F.col("creation_date_time")))
            .withColumn("is_late", F.lit(False) if limit is None else F.col("sec") < limit), "checked", batch)

        topic = F.lit(TOPIC_CREATED).alias("topic")
        refused = checked.filter("missing_reference IS NOT NULL").select(
            topic, F.concat_ws(" ", F.initcap("missing_reference"), F.lit("not found")).alias("reason"),
            F.to_json(F.struct(*columns)).alias("record"))
        rejected = intake.filter("reason IS NOT NULL").select(topic, "reason", "record")
        store.write(rejected.unionByName(refused), "dead_letters", batch)

        known = checked.filter("missing_reference IS NULL")
        store.write(known.filter("is_late").select(*_RECENT.names), "late", batch)
        # A repeated row that lies before the rows at hand is late.
        recent = self.recent(progress)
        fresh = known.filter("NOT is_late").join(recent.select("transaction_id"), "transaction_id", "left_anti")
        return store.write(fresh.select(*_RECENT.names).sortWithinPartitions("sec"), "transactions", batch), recent

    def features(self, fresh: DataFrame, recent: DataFrame, batch: int, progress: Progress) -> DataFrame:
        velocity = velocity_features(recent.unionByName(fresh), ttl_seconds=self.ttl_seconds).join(
            fresh.select("transaction_id"), "transaction_id", "left_semi")
        users = self.totals(self.users, progress, fresh)
        addresses = self.totals(self.addresses, progress, fresh.filter(~is_blank(F.col("ip_address"))))
        in_batch = running(
            fresh.select("transaction_id", "user_id", "sec", "amount"), ["user_id"], ["sec", "transaction_id"],
            {"_before": Agg("sum", F.lit(1)), "_amount_before": Agg("sum", F.col("amount"))}
        ).select("transaction_id", "_before", "_amount_before")
        rows = (
            enrich(fresh, self.dims.users, self.dims.merchants, self.dims.cards, self.dims.devices)
            .join(velocity, "transaction_id").join(in_batch, "transaction_id")
            .join(users.withColumnsRenamed({"n": "_n", "safe_n": "_safe_n", "safe_amount": "_safe", "last_sec": "_last"}), "user_id", "left")
        )
        ip_key = validate.spread_null_key(F.col("ip_address"), F.col("transaction_id"))
        rows = rows.join(
            addresses.withColumnsRenamed({"ip_address": "_ip", "n": "_ip_n", "points": "_points"}), ip_key == F.col("_ip"), "left")
        before = F.coalesce("_n", F.lit(0)) + F.coalesce("_before", F.lit(0))
        if self.safe_only:
            average = F.col("_safe").cast("double") / F.nullif(F.col("_safe_n"), F.lit(0))
        else:
            # All amounts count: those of earlier batches and of the user's earlier rows in this one.
            amount = F.coalesce(F.col("_safe"), F.lit(0)) + F.coalesce(F.col("_amount_before"), F.lit(0))
            average = amount.cast("double") / F.nullif(before, F.lit(0))
        since = F.col("seconds_since_last_transaction")
        if self.ttl_seconds is None:
            since = F.when(
                (since == S.NO_PREVIOUS_SECONDS) & F.col("_last").isNotNull(), F.col("sec") - F.col("_last")).otherwise(since)
        ts = F.col("creation_date_time")
        out = rows.withColumns({
            "user_average_amount": F.when(average > 0, average).otherwise(F.lit(S.COLD_START_AVERAGE)),
            "user_historical_transaction_count": before.cast("long"),
            "seconds_since_last_transaction": since,
            "ip_risk_score": F.coalesce(F.col("_points") / F.col("_ip_n"), F.lit(0.0)),
            "hour_of_day": hour_of_day(ts), "day_of_week": iso_weekday(ts),
            "card_age_days": whole_days(F.col("card_created_at"), ts),
            "user_account_age_days": whole_days(F.col("user_created_at"), ts),
        }).withColumn("amount_to_average_ratio", amount_to_average_ratio(F.col("amount"), F.col("user_average_amount")))
        return engineer_features(out).select(*S.TRANSACTION_SCHEMA.names, "sec", *[f for f in S.FEATURES if f != "amount"])

    def run_batch(self, messages: DataFrame, batch: int) -> None:
        store = self.store
        progress = store.progress_before(batch)
        fresh, recent = self.accept(messages, batch, progress)
        vectors = store.write(self.features(fresh, recent, batch, progress), "vectors", batch)
        safe = self.mark_safe if self.mark_safe is not None else F.lit(False)
        scored = store.write(self._scored(vectors).withColumn("is_marked_as_safe", safe), "scored", batch)
        store.write(scored.select(*S.PREDICTION_SCHEMA.names), "predictions", batch)
        store.write(scored_records(scored), "published", batch)
        self._enqueue(scored, batch)
        store.commit(batch, self._progress_after(scored, recent, batch, progress))

    def _scored(self, vectors: DataFrame) -> DataFrame:
        if self.releases is not None:
            low, high = vectors.agg(F.min("sec"), F.max("sec")).first()
            if low is not None:
                spans = self.releases(low, high)
                out = None
                for k, (first, bundle) in enumerate(spans):
                    inside = F.lit(True) if k == 0 else F.col("sec") >= first
                    if k + 1 < len(spans):
                        inside = inside & (F.col("sec") < spans[k + 1][0])
                    part = explain(score(vectors.filter(inside), bundle), bundle)
                    out = part if out is None else out.unionByName(part)
                return out
        if self.model is not None:
            bundle = self.model()
            return explain(score(vectors, bundle), bundle)
        unscored = vectors.withColumns({
            "raw_probability": F.lit(0.0), "fraud_probability": F.lit(0.0), "risk_level": F.lit("LOW"), "model_version": F.lit("none")})
        return unscored if self.releases is None else unscored.withColumn("contributions", F.array().cast(T.ArrayType(S.CONTRIBUTION_TYPE)))

    def _enqueue(self, scored: DataFrame, batch: int) -> None:
        """New alerts with what they are rendered from, due at their transaction's time. Ids are new in every batch, so
        only a rerun could repeat one, and it replaces its own directory."""
        none = self.store.spark.createDataFrame([], "transaction_id string")
        created = F.col("creation_date_time")
        self.store.write(outbox.enqueue_alerts(scored, none, self.now if self.now is not None else F.localtimestamp(), due=created), "tasks", batch)

    def _progress_after(self, scored: DataFrame, recent: DataFrame, batch: int, progress: Progress) -> Progress:
        """Writes the batch into the totals and the rows at hand; rows that leave these go to the totals' last second."""
        newest = scored.agg(F.max("sec")).first()[0]
        high = max((x for x in (progress.high_water, newest) if x is not None), default=None)
        horizon = self._horizon(high)
        counts = F.col("is_marked_as_safe") if self.safe_only else F.lit(True)
        arrived = scored.groupBy("user_id").agg(
            F.count("*").alias("n"), F.count_if(counts).alias("safe_n"),
            F.coalesce(F.sum(F.when(counts, F.col("amount"))), F.lit(0)).cast("decimal(29,2)").alias("safe_amount"),
            F.lit(None).cast("long").alias("last_sec"))
        if horizon is not None:
            left = recent.select("user_id", "sec").unionByName(scored.select("user_id", "sec")).filter(F.col("sec") < horizon)
            zeros = [F.lit(0).cast(_USER_TOTALS[c].dataType).alias(c) for c in ("n", "safe_n", "safe_amount")]
            arrived = arrived.unionByName(left.groupBy("user_id").agg(F.max("sec").alias("last_sec")).select("user_id", *zeros, "last_sec"))
        addresses = scored.filter(~is_blank(F.col("ip_address"))).groupBy("ip_address").agg(
            F.count("*").alias("n"), F.sum(risk_points(F.col("risk_level"))).alias("points"))
        totals, garbage = dict(progress.totals), [f"{t}/batch={batch}" for t in ("intake", "checked")]
        for kept, delta in ((self.users, arrived.filter("user_id IS NOT NULL")), (self.addresses, addresses)):
            after, gone = kept.merge(Buckets(**totals.get(kept.name, {})), self.store.write(delta, f"{kept.name}_delta", batch), batch)
            totals[kept.name] = asdict(after)
            garbage += [*gone, f"{kept.name}_delta/batch={batch}"]
        at_hand = scored.select(*_RECENT.names).filter(F.col("sec") >= (0 if horizon is None else horizon))
        hours, gone = self.rows.add(progress.hours, at_hand, horizon, batch)
        return Progress(high, hours, totals, garbage + gone)

    # ---- late rows ----
    def replay_late(self) -> int:
        """Scores late rows at their own time and corrects the rows they would have changed; returns how many rows.

        See `replay`. A late row takes address risk and safe average as they are now; a row that was published
        keeps its own. Both go to `corrections` with their whole vector, score and explanation.
        """
        store = self.store

        def whole(found: DataFrame, late: DataFrame) -> DataFrame:
            last = store.last_committed()
            progress = store.progress_before(last + 1)
            users, addresses = self.totals(self.users, progress, late), self.totals(self.addresses, progress, late.filter(~is_blank(F.col("ip_address"))))
            ts = F.col("creation_date_time")
            average = F.col("_safe").cast("double") / F.nullif(F.col("_safe_n"), F.lit(0))
            rows = (
                enrich(late, self.dims.users, self.dims.merchants, self.dims.cards, self.dims.devices)
                .join(users.select("user_id", F.col("safe_n").alias("_safe_n"), F.col("safe_amount").alias("_safe")), "user_id", "left")
                .join(addresses.select("ip_address", (F.col("points") / F.col("n")).alias("ip_risk_score")), "ip_address", "left")
                .withColumns({
                    "ip_risk_score": F.coalesce("ip_risk_score", F.lit(0.0)), "hour_of_day": hour_of_day(ts), "day_of_week": iso_weekday(ts),
                    "user_average_amount": F.when(average > 0, average).otherwise(F.lit(S.COLD_START_AVERAGE)),
                    "card_age_days": whole_days(F.col("card_created_at"), ts), "user_account_age_days": whole_days(F.col("user_created_at"), ts)})
            )
            kept = [*S.TRANSACTION_SCHEMA.names, "sec", *[f for f in S.BASE_FEATURES if f not in ("amount", "amount_to_average_ratio", *VELOCITY_COLUMNS,
                                                                                                   "user_historical_transaction_count")]]
            fresh = [c for c in kept if c in rows.columns]
            published = store.committed("vectors").select(*fresh).unionByName(rows.select(*fresh))
            out = published.join(found, "transaction_id")
            if not self.safe_only:
                out = out.withColumn("user_average_amount", F.coalesce("_average", "user_average_amount"))
            out = out.withColumn("amount_to_average_ratio", amount_to_average_ratio(F.col("amount"), F.col("user_average_amount")))
            vectors = engineer_features(out).select("kind", *S.TRANSACTION_SCHEMA.names, "sec", *[f for f in S.FEATURES if f != "amount"])
            return self._scored(vectors)

        return replay(store, "vectors", self.ttl_seconds, whole)


def start_scoring(stream: DataFrame, settings: ScoringStream, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Starts the stream over a frame with a `value` column of created-transaction messages."""
    writer = stream.writeStream.foreachBatch(lambda df, batch: settings.run_batch(df, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def velocity_stream(
    stream: DataFrame, store: BatchStore, checkpoint: str, *, ttl_seconds: int | None = None, once: bool = True
) -> StreamingQuery:
    """Velocity features of a transaction stream, batch by batch, into the store's `velocity`.

    Rows within an hour (plus the allowed lateness) of the newest are kept at hand; a user's last
    second before that comes from the running totals. Rows later than the allowed lateness go to the
    store's `late`, as in the scoring stream.
    """

    def run(df: DataFrame, batch: int) -> None:
        progress = store.progress_before(batch)
        rows = validate.deduplicate(df.select(*S.TRANSACTION_SCHEMA.names)).withColumn("sec", epoch_seconds(F.col("creation_date_time")))
        settings = ScoringStream(store, None, None, ttl_seconds)
        limit = None if progress.high_water is None else progress.high_water - settings.lateness_seconds
        late = F.lit(False) if limit is None else F.coalesce(F.col("sec") < limit, F.lit(False))
        rows = store.write(rows.withColumn("is_late", late).select(*_RECENT.names, "is_late"), "checked", batch)
        store.write(rows.filter("is_late").select(*_RECENT.names), "late", batch)
        # A repeated row that lies before the rows at hand is late.
        recent = settings.recent(progress)
        fresh = store.write(
            rows.filter("NOT is_late").join(recent.select("transaction_id"), "transaction_id", "left_anti").select(*_RECENT.names)
            .sortWithinPartitions("sec"), "transactions", batch)
        # One layout: rows at hand and new ones move once, and the new ones are known by a mark, not by a join.
        at_hand = recent.withColumn("_fresh", F.lit(False)).unionByName(fresh.withColumn("_fresh", F.lit(True)))
        out = user_features(at_hand, ttl_seconds=ttl_seconds).filter("_fresh AND transaction_id IS NOT NULL").select(
            "transaction_id", *VELOCITY_COLUMNS, "user_id", "sec")
        if ttl_seconds is None:
            seen = settings.totals(settings.users, progress, fresh).select("user_id", "last_sec")
            since = F.col("seconds_since_last_transaction")
            out = out.join(seen, "user_id", "left").withColumn(
                "seconds_since_last_transaction",
                F.when((since == S.NO_PREVIOUS_SECONDS) & F.col("last_sec").isNotNull(), F.col("sec") - F.col("last_sec")).otherwise(since))
        store.write(out.drop("user_id", "sec", "last_sec"), "velocity", batch)
        store.commit(batch, settings._progress_after(
            fresh.withColumns({"is_marked_as_safe": F.lit(False), "risk_level": F.lit("LOW")}), recent, batch, progress))

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


_HISTORY = ["user_historical_transaction_count"]


def replay(store: BatchStore, published: str, ttl_seconds: int | None, whole: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
    """Gives late rows their features and corrects the rows of the same users that they would have changed.

    A late row enters the windows of its user's next hour, the pause of the user's next row and all later counts.
    So of every user with late rows the rows from an hour before the first of them are worked out anew, with the
    rows before that as totals, and what differs from `published` goes to `corrections` (kind `late` or
    `corrected`), a folder a replay. `whole` makes corrections of (features, late rows) where more than the windows is
    wanted. Late rows that were redelivered, or replayed before, are left out. Run it between batches.
    """
    spark, number = store.spark, store.count_of("replays")
    known = store.committed("transactions").select(*_RECENT.names)
    done = store.committed_of("replayed", number, _RECENT)
    late = validate.deduplicate(store.committed("late").select(*_RECENT.names)).join(
        known.unionByName(done).select("transaction_id"), "transaction_id", "left_anti")
    late = store.write(late.select(*_RECENT.names), "replayed", number)
    known = known.unionByName(done)
    first = store.write(late.groupBy("user_id").agg(F.min("sec").alias("_first")), "replay_users", number)
    mine = known.join(first, "user_id")
    context = F.col("sec") >= F.col("_first") - S.ONE_HOUR
    near = mine.filter(context).select(*_RECENT.names, F.lit(0).alias("_late")).unionByName(late.select(*_RECENT.names, F.lit(1).alias("_late")))
    near = store.write(near, "replay_rows", number)
    older = mine.filter(~context).groupBy("user_id").agg(
        F.count("*").alias("_older"), F.max("sec").alias("_last"), F.sum("amount").alias("_older_amount"))
    if whole is None:
        # Windows alone: one layout, on which the rows carry what follows.
        windows = user_features(near, ttl_seconds=ttl_seconds).filter("transaction_id IS NOT NULL").drop(*HISTORY_COLUMNS).withColumns(
            {c: F.lit(0) for c in ("_before", "_sum")})
    else:
        counted = running(near, ["user_id"], ["sec", "transaction_id"], {"_before": Agg("sum", F.lit(1)), "_sum": Agg("sum", F.col("amount"))})
        windows = velocity_features(near.drop("_late", "sec"), ttl_seconds=ttl_seconds).join(
            counted.select("transaction_id", "user_id", "sec", "_late", "_before", "_sum"), "transaction_id")
    since, count = F.col("seconds_since_last_transaction"), F.coalesce("_older", F.lit(0)) + F.coalesce("_before", F.lit(0))
    amount = F.coalesce(F.col("_older_amount"), F.lit(0)) + F.coalesce(F.col("_sum"), F.lit(0))
    average = amount.cast("double") / F.nullif(count, F.lit(0))
    found = (
        windows.join(older, "user_id", "left").join(first, "user_id").filter(F.col("sec") >= F.col("_first"))
        .withColumns({
            "seconds_since_last_transaction": F.when(
                (since == S.NO_PREVIOUS_SECONDS) & F.col("_last").isNotNull() & F.lit(ttl_seconds is None), F.col("sec") - F.col("_last")).otherwise(since),
            "user_historical_transaction_count": count.cast("long"),
            "_average": F.when(average > 0, average).otherwise(F.lit(S.COLD_START_AVERAGE)),
            "kind": F.when(F.col("_late") == 1, "late").otherwise("corrected")})
    )
    columns = [*VELOCITY_COLUMNS, *[c for c in _HISTORY if whole is not None]]
    as_published = corrected(store, published, columns)
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).cast("double").eqNullSafe(F.col(f"_{c}").cast("double"))
    changed = found.select("transaction_id", *columns, "_average", "kind").join(
        as_published.select("transaction_id", *[F.col(c).alias(f"_{c}") for c in columns]), "transaction_id", "left")
    changed = changed.filter((F.col("kind") == "late") | differs).drop(*[f"_{c}" for c in columns])
    out = store.write(changed.drop("_average") if whole is None else whole(store.write(changed, "replay_found", number), late), "corrections", number)
    n = out.count()
    store.write(spark.createDataFrame([(n,)], "n long"), "replays", number)
    store.remove([f"{t}/batch={number}" for t in ("replay_users", "replay_rows", "replay_found")])
    return n


def corrected(store: BatchStore, published: str, columns: list[str]) -> DataFrame:
    """transaction_id and columns as of the last replay: the corrections, and what is published of the other rows."""
    rows = store.committed(published).select("transaction_id", *columns)
    number = store.count_of("replays")
    if not number:
        return rows
    newest = store.committed_of("corrections", number, T.StructType([*rows.schema.fields]), with_batch=True).groupBy("transaction_id").agg(
        F.max_by(F.struct(*columns), "batch").alias("_c")).select("transaction_id", "_c.*")
    return rows.join(newest.select("transaction_id"), "transaction_id", "left_anti").unionByName(newest)


def expire(store: BatchStore, batch: int) -> list[str]:
    """Removes now what the stream will not read again after `batch`, and names it; the next commit would.

    The batch cannot be run again afterwards.
    """
    gone = store.progress_before(batch + 1).garbage
    store.remove(gone)
    return gone
