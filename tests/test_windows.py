"""Velocity and history against brute force, on a small table full of ties and exact boundaries."""

import random
import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from riskflow.operators import ordered
from riskflow.operators.history import ip_history, previous_transaction, user_history
from riskflow.operators.ordered import Agg, large_groups, running
from riskflow.operators.velocity import velocity_features
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1, 10, 0, 0)
SCHEMA = ("transaction_id string, user_id string, merchant_id string, amount decimal(19,2), ip_address string, "
          "creation_date_time timestamp_ntz")
PRED = "transaction_id string, risk_level string, is_marked_as_safe boolean"


def make_rows(n=400, seed=5):
    rng = random.Random(seed)
    offsets = [0, 0, 0, 1, 299, 300, 301, 599, 600, 601, 3599, 3600, 3601, 7199, 7200, 7201, 10800, 90000]
    out = []
    for i in range(n):
        user = "hot" if rng.random() < 0.5 else f"u{rng.randrange(4)}"
        sec = rng.choice(offsets) + rng.choice([0, 0, 0, rng.randrange(0, 9000)])
        out.append((f"t{rng.randrange(10**6):06d}-{i}", user, f"m{rng.randrange(4)}", Decimal(rng.randrange(1, 5000)) / 100,
                    rng.choice(["1.1.1.1", "2.2.2.2", None, " "]), T0 + timedelta(seconds=sec)))
    return out


def brute(rows, ttl=None):
    result = {}
    by_user = {}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        by_user.setdefault(r[1], []).append(r)
    for items in by_user.values():
        session = []
        for r in items:
            t = r[5]
            if ttl is not None and session and (t - session[-1][5]).total_seconds() >= ttl:
                session = []
            hour = [p for p in session if (t - p[5]).total_seconds() <= 3600]
            five = [p for p in hour if (t - p[5]).total_seconds() <= 300]
            since = int((t - session[-1][5]).total_seconds()) if session else 2_592_000
            result[r[0]] = (len(five), len(hour), sum((p[3] for p in hour), Decimal(0)), len({p[2] for p in hour}), since)
            session.append(r)
    return result


@pytest.mark.parametrize("ttl", [None, 600])
@pytest.mark.parametrize("limit", [2_000_000, 30, 5])
def test_velocity_equals_brute_force(spark, ttl, limit):
    rows = make_rows()
    df = velocity_features(spark.createDataFrame(rows, SCHEMA), ttl_seconds=ttl, max_group_rows=limit)
    got = {r.transaction_id: tuple(r)[1:] for r in df.collect()}
    assert got == brute(rows, ttl)


def test_windows_take_their_exact_end(spark):
    rows = [("a", "u", "m1", Decimal("10.50"), None, T0), ("b", "u", "m1", Decimal("20"), None, T0 + timedelta(seconds=3300)),
            ("c", "u", "m2", Decimal("1"), None, T0 + timedelta(seconds=3600)), ("d", "u", "m2", Decimal("1"), None, T0 + timedelta(seconds=3901))]
    got = {r.transaction_id: r for r in velocity_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["c"].user_transaction_count_5min == 1 and got["c"].user_transaction_count_1hour == 2
    assert got["c"].amount_velocity_1hour == Decimal("30.50") and got["c"].distinct_merchant_count_1hour == 1
    assert got["d"].user_transaction_count_5min == 0 and got["d"].user_transaction_count_1hour == 2
    assert got["a"].seconds_since_last_transaction == 2_592_000


def test_pause_of_exactly_the_ttl_resets(spark):
    rows = [("a", "u", "m", Decimal(1), None, T0), ("b", "u", "m", Decimal(1), None, T0 + timedelta(seconds=599)),
            ("c", "u", "m", Decimal(1), None, T0 + timedelta(seconds=1199))]
    got = {r.transaction_id: r for r in velocity_features(spark.createDataFrame(rows, SCHEMA), ttl_seconds=600).collect()}
    assert got["b"].user_transaction_count_1hour == 1 and got["b"].seconds_since_last_transaction == 599
    assert got["c"].user_transaction_count_1hour == 0 and got["c"].seconds_since_last_transaction == 2_592_000


@pytest.mark.parametrize("limit", [2_000_000, 20])
def test_histories_equal_brute_force(spark, limit):
    rows = make_rows(300, 9)
    rng = random.Random(1)
    levels = {r[0]: rng.choice(["LOW", "MEDIUM", "HIGH"]) for r in rows if rng.random() < 0.9}
    tx = spark.createDataFrame(rows, SCHEMA)
    pred = spark.createDataFrame([(k, v, v != "HIGH") for k, v in levels.items()], PRED)
    safe = {r.transaction_id: (round(r[1], 9), r[2]) for r in user_history(tx, pred, safe_only=True, max_group_rows=limit).collect()}
    address = {r.transaction_id: round(r[1], 9) for r in ip_history(tx, pred, max_group_rows=limit).collect()}
    previous = {r.transaction_id: r.previous_transaction_id for r in previous_transaction(tx, max_group_rows=limit).collect()}
    points = {"HIGH": 1.0, "MEDIUM": 0.5}
    for r in rows:
        before = sorted((p for p in rows if p[1] == r[1] and (p[5], p[0]) < (r[5], r[0])), key=lambda p: (p[5], p[0]))
        amounts = [float(p[3]) for p in before if levels.get(p[0]) in ("LOW", "MEDIUM")]
        average = sum(amounts) / len(amounts) if amounts else 100.0
        assert safe[r[0]] == (pytest.approx(average), len(before))
        assert previous[r[0]] == (before[-1][0] if before else None)
        if (r[4] or "").strip():
            ip = [points.get(levels.get(p[0]), 0.0) for p in rows if p[4] == r[4] and (p[5], p[0]) < (r[5], r[0])]
            assert address[r[0]] == pytest.approx(sum(ip) / len(ip) if ip else 0.0)
        else:
            assert r[0] not in address


def test_large_groups_are_found_and_bounded(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    assert large_groups(df, ["k"], 900) is None
    assert [tuple(r) for r in large_groups(df, ["k"], 100).collect()] == [("hot", 900, 100)]


@pytest.mark.parametrize("limit", [40, 9, 700])
def test_running_splits_one_key_holding_everything(spark, limit):
    df = spark.range(5000).select(F.lit(1).alias("k"), "id", (F.col("id") % 7).alias("v"))
    aggs = {"s": Agg("sum", F.col("v")), "m": Agg("max", F.col("id"))}
    total = 0
    for r in sorted(running(df, ["k"], ["id"], aggs, max_rows=limit).collect(), key=lambda r: r.id):
        assert (r.s or 0) == total and r.m == (r.id - 1 if r.id else None)
        total += r.v


def test_chunks_are_ordered_and_bounded(spark):
    """A key of 20,000 rows at 500 a chunk: chunks follow the order and none nears the whole."""
    df = spark.range(20_000).select(F.when(F.col("id") < 19_000, "hot").otherwise("cold").alias("k"), F.xxhash64("id").alias("o"), "id")
    large = large_groups(df, ["k"], 5000)
    chunked = ordered._in_ranges(df.filter("k = 'hot'"), ["k"], ["o"], large.withColumn("_chunk_rows", F.lit(500).cast("long")))
    per = chunked.groupBy("k", "_chunk").agg(F.count("*").alias("n"), F.min("o").alias("lo"), F.max("o").alias("hi")).collect()
    hot = sorted((r for r in per if r.k == "hot"), key=lambda r: r["_chunk"])
    assert len(hot) > 20 and max(r.n for r in hot) < 4_000 and sum(r.n for r in hot) == 19_000
    assert all(a.hi < b.lo for a, b in zip(hot, hot[1:]))


def test_split_rows_are_spread_even_after_a_join_on_the_key(spark):
    """The chunk windows get their own exchange although the input is already hashed by key."""
    key = F.concat(F.lit("k"), F.least(F.col("id"), F.lit(0)).cast("string")).alias("k")
    df, other = spark.range(4000).select(key, "id"), spark.range(1).select(key, F.lit(1).alias("x"))
    joined = df.hint("merge").join(other, "k")
    plan = running(joined, ["k"], ["id"], {"s": Agg("sum", F.col("id"))}, max_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [k#" in plan
    assert re.search(r"hashpartitioning\(k#\d+, _chunk#\d+, \d+\), REPARTITION_BY_COL", plan)


def test_rows_without_keys_come_back(spark):
    from datetime import datetime

    from riskflow.operators.velocity import velocity_features

    at = datetime(2024, 1, 1, 10, 0)
    rows = [("a", "u", "m", 5, at), ("b", None, "m", 5, at), ("c", "u", None, 5, at), ("d", "u", "m", 5, None), ("e", "u", "m", 5, at.replace(minute=1))]
    tx = spark.createDataFrame(rows, "transaction_id string, user_id string, merchant_id string, amount int, creation_date_time timestamp_ntz")
    for ttl in (None, 600):
        got = {r.transaction_id: r.user_transaction_count_1hour for r in velocity_features(tx, ttl_seconds=ttl).collect()}
        assert got == {"a": 0, "b": None, "c": None, "d": None, "e": 1}


def test_rows_without_user_or_time_have_no_history_and_are_in_none(spark):
    rows = [("a", None, "m", Decimal(10), None, T0), ("b", None, "m", Decimal(500), None, T0 + timedelta(seconds=5)), ("c", " ", "m", Decimal(90), None, T0),
            ("d", "u", "m", Decimal(7), "1.1.1.1", None), ("e", "u", "m", Decimal(8), "1.1.1.1", T0), ("f", "u", "m", Decimal(9), "1.1.1.1", T0)]
    tx = spark.createDataFrame(rows, SCHEMA)
    got = {r.transaction_id: tuple(r)[1:] for r in user_history(tx, None).collect()}
    assert got == {**dict.fromkeys("abcd", (None, None)), "e": (100.0, 0), "f": (8.0, 1)}
    before = {r.transaction_id: r.previous_transaction_id for r in previous_transaction(tx).collect()}
    assert before == {**dict.fromkeys("abcde"), "f": "e"}
    assert {r.transaction_id for r in ip_history(tx, spark.createDataFrame([], PRED)).collect()} == {"e", "f"}


def _incomplete(rows):
    """Some rows without user, merchant, time, address, amount; some with a blank user."""
    gone = {3: 1, 4: 2, 5: 4, 6: 5, 7: 3}
    out = []
    for i, r in enumerate(rows):
        r = list(r)
        if i % 17 in gone:
            r[gone[i % 17]] = None
        elif i % 17 == 8:
            r[1] = " "
        out.append(tuple(r))
    return out


@pytest.mark.parametrize("ttl, limit, safe_only", [
    (None, 2_000_000, True), (5000, 2_000_000, False), (None, 100, False), (600, 100, True), (5000, 5, True)])
def test_one_layout_equals_the_single_operators(spark, ttl, limit, safe_only):
    """At 100 the hot user alone takes the operators that cut by the hour, at 5 every user does."""
    from riskflow.operators.user_windows import USER_COLUMNS, user_features

    tx = spark.createDataFrame(_incomplete(make_rows(500, 11)), SCHEMA)
    pred = tx.select("transaction_id", (F.crc32(F.encode("transaction_id", "utf-8")) % 3 > 0).alias("is_marked_as_safe")).filter(
        F.crc32(F.encode("transaction_id", "utf-8")) % 10 > 0)
    got = user_features(tx.join(pred, "transaction_id", "left").withColumn("carried", F.lit(7)),
                        ttl_seconds=ttl, safe_only=safe_only, max_group_rows=limit)
    want = velocity_features(tx, ttl_seconds=ttl).join(user_history(tx, pred, safe_only=safe_only), "transaction_id")
    assert [f.dataType for f in got.select(*USER_COLUMNS).schema] == [f.dataType for f in want.select(*USER_COLUMNS).schema]
    found = got.select("transaction_id", *USER_COLUMNS, "carried").collect()
    assert len(found) == 500 and {r.carried for r in found} == {7}
    assert {r.transaction_id: tuple(r)[1:-1] for r in found} == {
        r.transaction_id: tuple(r)[1:] for r in want.select("transaction_id", *USER_COLUMNS).collect()}


def test_one_layout_equals_brute_force(spark):
    from riskflow.operators.user_windows import user_features
    from riskflow.operators.velocity import VELOCITY_COLUMNS

    rows = make_rows(400, 23)
    for ttl in (None, 600, 5000):
        got = user_features(spark.createDataFrame(rows, SCHEMA), ttl_seconds=ttl).select("transaction_id", *VELOCITY_COLUMNS)
        assert {r.transaction_id: tuple(r)[1:] for r in got.collect()} == brute(rows, ttl)
    empty = user_features(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []


@pytest.mark.parametrize("limit", [2_000_000, 20])
def test_address_risk_on_the_carried_rows(spark, limit):
    from riskflow.operators.history import address_key, with_address_risk, with_predictions

    tx = spark.createDataFrame(_incomplete(make_rows(300, 9)), SCHEMA)
    pred = tx.select("transaction_id", F.element_at(F.array(*map(F.lit, ["LOW", "MEDIUM", "HIGH"])), (F.crc32(F.encode("transaction_id", "utf-8")) % 3 + 1).cast("int")).alias("risk_level"))
    want = {r.transaction_id: r.ip_risk_score for r in ip_history(tx, pred).collect()}
    keyed = with_predictions(tx, pred).withColumn("_address", address_key())
    large = large_groups(keyed.filter("startswith(_address, '+')"), ["_address"], limit)
    got = {r.transaction_id: r.ip_risk_score for r in with_address_risk(keyed, large, max_group_rows=limit).collect()}
    assert (large is None) == (limit > 20)
    assert got == pytest.approx({r.transaction_id: want.get(r.transaction_id, 0.0) for r in tx.collect()})


def test_one_layout_sorts_twice_without_sessions(spark):
    from riskflow.operators.user_windows import user_features

    found = user_features(spark.createDataFrame(make_rows(20), SCHEMA), large_users=None)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert len(re.findall(r"\bSort \[", plan)) == 2
