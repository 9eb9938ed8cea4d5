"""The scoring stream batch by batch: replays, redelivery, late rows, dead letters, folding of totals."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from riskflow import schemas as S
from riskflow.operators.history import user_history
from riskflow.operators.velocity import velocity_features
from riskflow.plans.feature_vector import Dimensions
from riskflow.streaming import scoring, state
from riskflow.streaming.scoring import ScoringStream
from riskflow.streaming.store import BatchStore

T0 = datetime(2024, 1, 1, 10, 0, 0)


def message(i, user="u1", at=0, amount=10, merchant="m1", **more):
    return json.dumps({"transactionId": f"t{i}", "userId": user, "cardId": "c1", "merchantId": merchant, "deviceId": None, "amount": amount,
                       "countryCode": "US", "ipAddress": "1.1.1.1", "creationDateTime": (T0 + timedelta(seconds=at)).isoformat(), **more})


@pytest.fixture()
def settings(spark, tmp_path):
    day = datetime(2023, 1, 1)
    dims = Dimensions(
        spark.createDataFrame([("u1", "US", day), ("u2", "DE", day)], "user_id string, home_country_code string, creation_date_time timestamp_ntz"),
        spark.createDataFrame([("m1", 0.5, "TRAVEL"), ("m2", 0.1, "OTHER")], "merchant_id string, risk_score double, category string"),
        spark.createDataFrame([("c1", "DEBIT", day)], "card_id string, type string, creation_date_time timestamp_ntz"),
        spark.createDataFrame([("d1",)], "device_id string"))
    return ScoringStream(BatchStore(spark, str(tmp_path / "store")), dims, None, ttl_seconds=None, safe_only=False,
                         now=F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz"))


def run(settings, batch, *values):
    settings.run_batch(settings.store.spark.createDataFrame([(v,) for v in values], "value string"), batch)


def test_features_carry_over_batches(settings):
    run(settings, 0, message(1, at=0, amount=20), message(2, at=100, amount=40, merchant="m2"))
    run(settings, 1, message(3, at=200), message(4, "u2", at=210))
    run(settings, 2, message(5, at=9000))
    got = {r.transaction_id: r for r in settings.store.committed("scored").collect()}
    assert (got["t3"].user_transaction_count_5min, got["t3"].amount_velocity_1hour, got["t3"].distinct_merchant_count_1hour) == (2, 60, 2)
    assert got["t3"].user_historical_transaction_count == 2 and got["t3"].user_average_amount == 30
    assert got["t4"].has_country_mismatch and got["t4"].user_historical_transaction_count == 0
    assert got["t5"].seconds_since_last_transaction == 8800 and got["t5"].user_transaction_count_1hour == 0
    assert got["t5"].user_historical_transaction_count == 3


def test_redelivery_counts_once_and_reruns_replace(settings):
    run(settings, 0, message(1), message(1))
    run(settings, 1, message(1), message(2, at=50))
    run(settings, 1, message(1), message(2, at=50))
    rows = settings.store.committed("transactions").collect()
    assert sorted(r.transaction_id for r in rows) == ["t1", "t2"]
    assert {r.transaction_id: r.user_historical_transaction_count for r in settings.store.committed("scored").collect()} == {"t1": 0, "t2": 1}


def test_uncommitted_batch_does_not_count(settings):
    run(settings, 0, message(1))
    settings.store.write(settings.store.committed("transactions").drop("batch"), "transactions", 1)
    assert settings.store.committed("transactions").count() == 1


def test_bad_records_go_to_dead_letters(settings):
    run(settings, 0, message(1), "{broken", message(2, amount=0), message(3, user="nobody"), message(4, userId=None))
    reasons = sorted(r.reason for r in settings.store.committed("dead_letters").collect())
    assert reasons == ["User not found", "Validation failed: [amount: must be greater than 0]",
                       "Validation failed: [userId: must not be blank]", "unreadable record"]
    assert [r.transaction_id for r in settings.store.committed("transactions").collect()] == ["t1"]


def test_late_rows_are_kept_aside(settings):
    run(settings, 0, message(1, at=5000))
    run(settings, 1, message(2, at=4400), message(3, at=4399))
    assert [r.transaction_id for r in settings.store.committed("late").collect()] == ["t3"]
    assert sorted(r.transaction_id for r in settings.store.committed("scored").collect()) == ["t1", "t2"]


def test_velocity_stream_keeps_late_rows_and_late_repeats_aside(spark, tmp_path):
    store, files = BatchStore(spark, str(tmp_path / "v")), str(tmp_path / "in")

    def deliver(*rows):
        values = [(f"t{i}", "u1", "c1", "m1", None, Decimal(10), "US", None, T0 + timedelta(seconds=at)) for i, at in rows]
        names = ["transaction_id", "user_id", "card_id", "merchant_id", "device_id", "amount", "country_code", "ip_address", "creation_date_time"]
        by_name = [tuple(dict(zip(names, v))[c] for c in S.TRANSACTION_SCHEMA.names) for v in values]
        spark.createDataFrame(by_name, S.TRANSACTION_SCHEMA).coalesce(1).write.mode("append").parquet(files)
        scoring.velocity_stream(spark.readStream.schema(S.TRANSACTION_SCHEMA).parquet(files), store, str(tmp_path / "state")).awaitTermination()

    deliver((1, 0), (2, 1000), (3, 90_000))
    deliver((1, 0), (4, 1100), (5, 89_400), (3, 90_000), (6, 90_010))
    assert sorted(r.transaction_id for r in store.committed("velocity").collect()) == ["t1", "t2", "t3", "t5", "t6"]
    assert sorted(r.transaction_id for r in store.committed("late").collect()) == ["t1", "t4"]
    stream = ScoringStream(store, None, None)
    keys = spark.createDataFrame([("u1",)], "user_id string")
    assert [r.n for r in stream.totals(stream.users, store.progress_before(store.last_committed() + 1), keys).collect()] == [5]
    got = {r.transaction_id: r.user_transaction_count_1hour for r in store.committed("velocity").collect()}
    assert got["t5"] == 0 and got["t6"] == 2


def test_unknown_devices_are_refused_or_untrusted(settings):
    run(settings, 0, message(1, deviceId="d9"), message(2, deviceId="d1", at=5))
    assert [r.reason for r in settings.store.committed("dead_letters").collect()] == ["Device not found"]
    assert [r.transaction_id for r in settings.store.committed("scored").collect()] == ["t2"]
    settings.refuse_unknown_devices = False
    run(settings, 1, message(3, deviceId="d9", at=10))
    got = {r.transaction_id: r.is_device_trusted for r in settings.store.committed("scored").collect()}
    assert got == {"t2": True, "t3": False}


def test_old_rows_of_a_long_batch_count_through_totals(settings):
    run(settings, 0, message(1, at=0), message(2, "u2", at=0), message(3, at=90_000))
    progress = settings.store.progress_before(1)
    assert [r.transaction_id for r in settings.recent(progress).collect()] == ["t3"]
    run(settings, 1, message(4, "u2", at=90_010), message(5, at=90_020))
    got = {r.transaction_id: r for r in settings.store.committed("scored").collect()}
    assert (got["t4"].seconds_since_last_transaction, got["t4"].user_historical_transaction_count) == (90_010, 1)
    assert (got["t5"].seconds_since_last_transaction, got["t5"].user_historical_transaction_count) == (20, 2)


def test_totals_are_cut_to_the_keys_of_the_batch(settings):
    run(settings, 0, message(1), message(2, "u2"))
    keys = settings.store.spark.createDataFrame([("u2",)], "user_id string")
    progress = settings.store.progress_before(1)
    got = settings.totals(settings.users, progress, keys).collect()
    assert [(r.user_id, r.n) for r in got] == [("u2", 1)]


def test_merged_rows_and_split_buckets_change_no_result(settings, monkeypatch):
    monkeypatch.setattr(state, "MERGE", 2)
    monkeypatch.setattr(state, "BUCKET_ROWS", 1)
    times = [0, 5000, 10_000, 15_000, 14_500, 20_000]
    for b, at in enumerate(times):
        run(settings, b, message(b, at=at, amount=10 * (b + 1)), message(100 + b, "u2", at=at))
    progress = settings.store.progress_before(len(times))
    assert progress.totals["user_totals"]["depth"] > 0
    tx = settings.store.committed("transactions").filter("user_id = 'u1'")
    want = {r.transaction_id: r.seconds_since_last_transaction for r in velocity_features(tx).collect()}
    got = {r.transaction_id: r for r in settings.store.committed("scored").filter("user_id = 'u1'").collect()}
    # The row of batch 3 was scored before the earlier one of batch 4 arrived.
    assert {k: v.seconds_since_last_transaction for k, v in got.items() if k not in ("t3", "t5")} == {
        k: v for k, v in want.items() if k not in ("t3", "t5")}
    assert got["t3"].seconds_since_last_transaction == 5000 and got["t5"].seconds_since_last_transaction == 5000
    assert got["t5"].user_historical_transaction_count == 5 and got["t5"].user_average_amount == 30


def test_what_a_batch_reads_does_not_grow_with_batches_or_keys(spark, tmp_path, monkeypatch):
    """Totals of ever more keys: a batch of two keys reads two buckets of bounded size, and replaced files go."""
    monkeypatch.setattr(state, "BUCKET_ROWS", 20)
    store = BatchStore(spark, str(tmp_path / "s"))
    kept, at, gone = state.KeyedTotals(store, "user_totals", "user_id", scoring._USER_TOTALS, ("last_sec",)), state.Buckets(), []
    for b in range(6):
        rows = spark.range(100 * b, 100 * (b + 1)).select(
            F.concat(F.lit("u"), "id").alias("user_id"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("safe_n"),
            F.lit(0).cast("decimal(29,2)").alias("safe_amount"), F.lit(b).cast("long").alias("last_sec"))
        store.remove(gone)
        at, gone = kept.merge(at, rows.unionByName(rows.limit(1).withColumn("user_id", F.lit("u7"))), b)
        sizes = [n for _, n in at.parts.values()]
        assert sum(sizes) == 100 * (b + 1) and max(sizes) < 60
        keys = spark.createDataFrame([("u7",), ("u55",), ("nobody",)], "user_id string")
        assert len(kept.paths(at, kept._touched(at, keys))) <= 3
        assert {r.user_id: r.n for r in kept.lookup(at, keys).collect()} == {"u7": b + 2, "u55": 1}
    store.remove(gone)
    left = {str(p.parent.relative_to(tmp_path / "s")) for p in (tmp_path / "s").rglob("*.parquet")}
    assert left == set(kept.paths(at))


def test_rows_behind_the_horizon_are_removed(spark, settings, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "MERGE", 3)
    for b in range(6):
        run(settings, b, message(b, at=1800 * b))
    progress = settings.store.progress_before(6)
    horizon = settings._horizon(progress.high_water)
    assert sorted(r.transaction_id for r in settings.recent(progress).collect()) == [f"t{b}" for b in range(6) if 1800 * b >= 9000 - 600 - 3600]
    assert all(int(h) >= horizon // 3600 for h in progress.hours) and sum(map(len, progress.hours.values())) <= 6
    gone = scoring.expire(settings.store, 5)
    assert any(p.startswith("recent_0") for p in gone)
    files = {str(p.parent.relative_to(tmp_path / "store")) for t in ("recent_*", "user_totals_0", "ip_totals_0") for p in (tmp_path / "store").glob(f"{t}/**/*.parquet")}
    assert files == set(settings.rows.paths(progress.hours)) | set(settings.users.paths(state.Buckets(**progress.totals["user_totals"]))) | set(
        settings.addresses.paths(state.Buckets(**progress.totals["ip_totals"])))
    assert not (tmp_path / "store" / "intake").exists() or not list((tmp_path / "store" / "intake").glob("batch=*"))


@pytest.mark.parametrize("ttl", [None, 600])
def test_late_rows_are_replayed_and_others_corrected(settings, ttl):
    """After the replay every row has the features of a stream in time order."""
    settings.ttl_seconds = ttl
    at = {1: 0, 2: 500, 3: 900, 4: 3000, 5: 4500, 6: 20_000, 7: 20_300, 8: 90_000, 9: 400, 10: 700, 11: 20_200, 12: 700}
    of = lambda i: message(i, "u2" if i == 12 else "u1", at=at[i], amount=i, merchant="m2" if i % 3 else "m1")
    run(settings, 0, *[of(i) for i in (1, 2, 3, 4, 5)])
    run(settings, 1, *[of(i) for i in (6, 7)])
    run(settings, 2, of(8), of(9), of(10))
    assert settings.replay_late() > 2
    run(settings, 3, of(11), of(12), of(9))
    assert settings.replay_late() > 2 and settings.replay_late() == 0
    names = [*scoring.VELOCITY_COLUMNS, "user_historical_transaction_count", "user_average_amount"]
    got = {r.transaction_id: tuple(r)[1:] for r in scoring.corrected(settings.store, "vectors", names).collect()}
    tx = settings.store.committed("transactions").select(*S.TRANSACTION_SCHEMA.names).unionByName(
        settings.store.committed("late").select(*S.TRANSACTION_SCHEMA.names).dropDuplicates(["transaction_id"]))
    want = {r.transaction_id: tuple(r)[1:] for r in velocity_features(tx, ttl_seconds=ttl).join(
        user_history(tx, None), "transaction_id").select("transaction_id", *names).collect()}
    assert got == want and len(got) == 12
    kinds = {r.transaction_id: r.kind for r in settings.store.spark.read.parquet(f"{settings.store.root}/corrections").collect() if r.kind == "late"}
    assert set(kinds) == {"t9", "t10", "t11", "t12"}


def test_streamed_alerts_carry_their_payload(settings, monkeypatch):
    monkeypatch.setattr(settings, "_scored", lambda v: v.withColumns({
        "raw_probability": F.lit(0.9), "fraud_probability": F.lit(0.9), "risk_level": F.lit("HIGH"), "model_version": F.lit("x")}))
    run(settings, 0, message(1, at=7))
    task = settings.store.committed("tasks").first()
    assert (task.status, task.attempts, task.next_retry_at) == ("PENDING_LLM", 0, T0 + timedelta(seconds=7))
    payload = json.loads(task.payload)
    assert payload["transaction_id"] == "t1" and payload["fraud_probability"] == 0.9 and "is_night" in payload


def test_rows_are_scored_by_the_release_of_their_own_time(settings, monkeypatch):
    class Named:
        def __init__(self, version):
            self.version = version

    monkeypatch.setattr(scoring, "score", lambda v, b: v.withColumns({
        "raw_probability": F.lit(0.1), "fraud_probability": F.lit(0.1), "risk_level": F.lit("LOW"), "model_version": F.lit(b.version)}))
    monkeypatch.setattr(scoring, "explain", lambda v, b: v.withColumn("contributions", F.array().cast(T.ArrayType(S.CONTRIBUTION_TYPE))))
    start = int((T0 - datetime(1970, 1, 1)).total_seconds())
    settings.releases = lambda low, high: [(start - 5, Named("a")), (start + 100, Named("b"))]
    run(settings, 0, message(1, at=0), message(2, at=99), message(3, at=100), message(4, "u2", at=400))
    run(settings, 1)
    assert {r.transaction_id: r.model_version for r in settings.store.committed("scored").collect()} == {"t1": "a", "t2": "a", "t3": "b", "t4": "b"}


def test_empty_batch(settings):
    run(settings, 0, message(1))
    run(settings, 1)
    run(settings, 2, message(2, at=10))
    assert {r.transaction_id: r.user_transaction_count_5min for r in settings.store.committed("scored").collect()} == {"t1": 0, "t2": 1}


def test_streamed_windows_and_replayed_ones_lie_on_one_layout(spark, tmp_path, monkeypatch):
    from riskflow.operators.velocity import VELOCITY_COLUMNS

    def refuse(*a, **k):
        raise AssertionError("windows by the hour")

    monkeypatch.setattr(scoring, "velocity_features", refuse)
    files, store = str(tmp_path / "in"), BatchStore(spark, str(tmp_path / "store"))
    at = lambda s: datetime(2024, 1, 2, 10) + timedelta(seconds=s)
    row = lambda i, s: (f"t{i}", "u1", "c1", f"m{i % 2}", None, Decimal("5.00"), "DE", None, at(s))
    names = ["transaction_id", "user_id", "card_id", "merchant_id", "device_id", "amount", "country_code", "ip_address", "creation_date_time"]
    every = [row(0, 0), row(1, 60), row(2, 1800), row(3, 9000), row(4, 9060), row(5, 900)]
    for part in (every[:3], every[3:]):
        df = spark.createDataFrame([tuple(dict(zip(names, r))[n] for n in S.TRANSACTION_SCHEMA.names) for r in part], S.TRANSACTION_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(files)
        scoring.velocity_stream(spark.readStream.schema(S.TRANSACTION_SCHEMA).parquet(files), store, str(tmp_path / "state")).awaitTermination()
    assert [r.transaction_id for r in store.committed("late").collect()] == ["t5"]
    assert scoring.replay(store, "velocity", None) == 2  # the late row, and the one behind it that it enters
    df = spark.createDataFrame([tuple(dict(zip(names, r))[n] for n in S.TRANSACTION_SCHEMA.names) for r in every], S.TRANSACTION_SCHEMA)
    want = {tuple(r) for r in velocity_features(df).select("transaction_id", *VELOCITY_COLUMNS).collect()}
    assert {tuple(r) for r in scoring.corrected(store, "velocity", VELOCITY_COLUMNS).collect()} == want
