"""Literal cases: validation, tiers, encodings, engineered features, outbox, alerts, registry."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import Row, functions as F

from riskflow import schemas as S
from riskflow.functions import scalar
from riskflow.operators import alerts, explain, messages, monitor, outbox, registry, validate
from riskflow.plans.feature_vector import engineer_features

NOON = datetime(2024, 6, 15, 14, 0)


def now():
    return F.lit(NOON).cast("timestamp_ntz")


GOOD = ("t", "u", "c", "m", None, Decimal("10.00"), "US", None, datetime(2024, 6, 15, 14, 0))


def tx(spark, **changes):
    row = dict(zip(S.TRANSACTION_SCHEMA.names, GOOD))
    return spark.createDataFrame([tuple({**row, **changes}.values())], S.TRANSACTION_SCHEMA)


@pytest.mark.parametrize("change, field", [
    ({}, None), ({"user_id": " "}, "userId"), ({"card_id": None}, "cardId"), ({"merchant_id": ""}, "merchantId"),
    ({"amount": None}, "amount"), ({"amount": Decimal(0)}, "amount"), ({"amount": Decimal(-1)}, "amount"),
    ({"country_code": "XX"}, "countryCode"), ({"country_code": None}, "countryCode"),
    ({"creation_date_time": None}, "creationDateTime"), ({"creation_date_time": datetime(2024, 6, 15, 14, 0, 1)}, "creationDateTime"),
    ({"device_id": None, "ip_address": None}, None),
])
def test_transaction_rules(spark, change, field):
    found = validate.validate_transactions(tx(spark, **change), now()).first().violations
    assert [v.field for v in found] == ([field] if field else [])


def test_id_required_only_downstream(spark):
    assert not validate.validate_transactions(tx(spark, transaction_id=" "), now()).first().violations
    assert validate.validate_transactions(tx(spark, transaction_id=" "), now(), require_id=True).first().violations


def test_default_id_keeps_supplied_ones(spark):
    assert validate.default_transaction_id(tx(spark)).first().transaction_id == "t"
    assert len(validate.default_transaction_id(tx(spark, transaction_id=None)).first().transaction_id) == 36


def test_message_text(spark):
    df = validate.validate_transactions(tx(spark, user_id="", amount=Decimal(0)), now())
    text = df.select(validate.violation_message(F.col("violations")).alias("m")).first().m
    assert text == "Validation failed: [userId: must not be blank] [amount: must be greater than 0]"


@pytest.mark.parametrize("values, bad", [
    ({"amount": 0.0}, ["amount"]), ({"amount": -1.0}, ["amount"]), ({"merchant_risk_score": 1.5}, ["merchant_risk_score"]),
    ({"hour_of_day": 24}, ["hour_of_day"]), ({"day_of_week": 0}, ["day_of_week"]), ({"card_type": 4}, ["card_type"]),
    ({"ip_risk_score": None}, ["ip_risk_score"]), ({}, []),
])
def test_feature_ranges(spark, values, bad):
    row = {"amount": 1.0, "merchant_risk_score": 0.5, "hour_of_day": 23, "day_of_week": 7, "card_type": 3, "ip_risk_score": 0.0, **values}
    schema = "amount double, merchant_risk_score double, hour_of_day int, day_of_week int, card_type int, ip_risk_score double"
    assert validate.validate_features(spark.createDataFrame([tuple(row.values())], schema)).first().feature_violations == bad


def test_contract_names_missing_features(spark):
    with pytest.raises(validate.FeatureContractError, match="amount, hour_of_day"):
        validate.check_contract(spark.range(1), ["id", "hour_of_day", "amount"])


def test_reference_precedence(spark):
    ids = lambda kind, *v: spark.createDataFrame([(x,) for x in v] or [], f"{kind}_id string")
    check = lambda t, u, m, c, d: validate.check_references(t, ids("user", *u), ids("merchant", *m), ids("card", *c), ids("device", *d)).first().missing_reference
    assert check(tx(spark), [], [], [], []) == "user"
    assert check(tx(spark), ["u"], [], [], []) == "merchant"
    assert check(tx(spark), ["u"], ["m"], [], []) == "card"
    assert check(tx(spark), ["u"], ["m"], ["c"], []) is None
    assert check(tx(spark, device_id="d"), ["u"], ["m"], ["c"], []) == "device"
    assert check(tx(spark, device_id=" "), ["u"], ["m"], ["c"], []) is None


def test_insert_if_absent_and_deduplicate(spark):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    rows = spark.createDataFrame([("a", 2), ("b", 5), ("b", 3)], "k string, v int")
    assert [tuple(r) for r in validate.insert_if_absent(target, rows, "k").collect()] == [("b", 3)]
    assert validate.deduplicate(tx(spark).unionByName(tx(spark))).count() == 1


def value(spark, column, **row):
    return spark.createDataFrame([Row(**row)]).select(column.alias("v")).first().v


@pytest.mark.parametrize("p, level, safe", [(0.71, "HIGH", False), (0.70, "MEDIUM", False), (0.6999, "MEDIUM", True), (0.30, "LOW", True), (0.3001, "MEDIUM", True)])
def test_bands(spark, p, level, safe):
    assert value(spark, scalar.risk_band(F.col("p")), p=p) == level
    assert value(spark, scalar.is_safe(F.col("p")), p=p) is safe


@pytest.mark.parametrize("p, level", [(0.8, "HIGH"), (0.79, "MEDIUM"), (0.4, "MEDIUM"), (0.39, "LOW")])
def test_threshold_levels(spark, p, level):
    assert value(spark, scalar.risk_level(F.col("p"), 0.8), p=p) == level


def test_encodings_default(spark):
    assert value(spark, scalar.encode_category(F.col("c")), c="TRAVEL") == 3
    assert value(spark, scalar.encode_category(F.col("c")), c="NOPE") == 7
    assert value(spark, scalar.encode_card_type(F.lit(None).cast("string")), c=1) == 3


def test_clips_keep_nulls(spark):
    assert value(spark, scalar.at_most(F.lit(None).cast("double"), 5.0), c=1) is None
    assert value(spark, scalar.at_least(F.lit(None).cast("double"), 5.0), c=1) is None
    assert value(spark, scalar.at_most(F.lit(9.0), 5.0), c=1) == 5.0


@pytest.mark.parametrize("x, seconds", [(1_704_067_200, 1_704_067_200), (1_704_067_200_999, 1_704_067_200), (10_000_000_000, 10_000_000_000)])
def test_epoch(spark, x, seconds):
    assert value(spark, scalar.normalize_epoch(F.col("x")), x=x) == seconds


@pytest.mark.parametrize("member, amount, merchant", [
    ("t:10.50", Decimal("10.50"), "10.50"), ("a:b:20", Decimal("20.00"), "20"), ("plain", None, "plain"), ("t:", None, "t:")])
def test_members(spark, member, amount, merchant):
    assert value(spark, scalar.member_amount(F.col("m")), m=member) == amount
    assert value(spark, scalar.member_merchant(F.col("m")), m=member) == merchant


def test_calendar(spark):
    sunday, night = datetime(2024, 6, 16, 23, 0), datetime(2024, 6, 16, 22, 59, 59)
    df = spark.createDataFrame([(sunday, night)], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(scalar.iso_weekday(F.col("a")).alias("w"), scalar.hour_of_day(F.col("a")).alias("h"),
                  scalar.whole_days(F.col("b") - F.expr("INTERVAL '1' DAY"), F.col("a")).alias("d1"),
                  scalar.whole_days(F.col("a") - F.expr("INTERVAL '30' DAY"), F.col("b")).alias("d2")).first()
    assert tuple(r) == (7, 23, 1, 29)


@pytest.mark.parametrize("amount, average, ratio", [("200", 100.0, 2.0), ("10", 0.5, 10.0), ("1", 3.0, 0.3333), ("0.05", 1000.0, 0.0001)])
def test_ratio(spark, amount, average, ratio):
    assert value(spark, scalar.amount_to_average_ratio(F.col("a"), F.col("b")), a=Decimal(amount), b=average) == ratio


def test_engineered_golden_row(spark):
    row = Row(amount=1_000_000.0, user_average_amount=100.0, merchant_risk_score=0.88, ip_risk_score=0.91, is_device_trusted=False,
              has_country_mismatch=True, hour_of_day=2, user_transaction_count_5min=0, user_transaction_count_1hour=0,
              seconds_since_last_transaction=0, amount_velocity_1hour=0.0, amount_to_average_ratio=10_000.0)
    r = engineer_features(spark.createDataFrame([row])).first()
    assert r.amount_deviation == 9_999 and r.amount_x_merchant_risk == pytest.approx(880_000)
    assert r.risk_score_product == pytest.approx(0.8008) and r.ip_device_risk == 0.91 and r.country_ip_risk == 0.91
    assert r.is_night is True and r.recency_velocity == 0
    capped = engineer_features(spark.createDataFrame([row]), {"amount_x_merchant_risk": 5.0}).first()
    assert capped.amount_x_merchant_risk == 5.0


TASK = "transaction_id string, status string, attempts int, next_retry_at timestamp_ntz"
OUTCOME = "transaction_id string, llm_ok boolean, email_ok boolean"
DUE = datetime(2024, 6, 15, 13, 0)


@pytest.mark.parametrize("status, attempts, llm, mail, after, tries, delay", [
    ("PENDING_LLM", 0, True, True, "COMPLETED", 0, None), ("PENDING_LLM", 0, False, True, "PENDING_LLM", 1, 30),
    ("PENDING_LLM", 2, True, False, "PENDING_EMAIL", 3, 120), ("PENDING_EMAIL", 3, False, False, "PENDING_EMAIL", 4, 240),
    ("PENDING_EMAIL", 4, True, False, "DEAD_LETTER", 5, None), ("PENDING_EMAIL", 1, False, True, "COMPLETED", 1, None),
    ("COMPLETED", 1, False, False, "COMPLETED", 1, None),
])
def test_task_transition(spark, status, attempts, llm, mail, after, tries, delay):
    out = outbox.advance_tasks(spark.createDataFrame([("t", status, attempts, DUE)], TASK),
                               spark.createDataFrame([("t", llm, mail)], OUTCOME), now()).first()
    assert (out.status, out.attempts) == (after, tries)
    if delay:
        assert (out.next_retry_at - datetime(2024, 6, 15, 14, 0)).total_seconds() == delay


def test_task_not_due_stays(spark):
    late = datetime(2024, 6, 15, 15, 0)
    out = outbox.advance_tasks(spark.createDataFrame([("t", "PENDING_LLM", 1, late)], TASK),
                               spark.createDataFrame([("t", True, True)], OUTCOME), now()).first()
    assert (out.status, out.attempts, out.next_retry_at) == ("PENDING_LLM", 1, late)


def test_alert_is_queued_once(spark):
    scored = spark.createDataFrame([("a", "HIGH"), ("a", "HIGH"), ("b", "LOW"), ("c", "HIGH")], "transaction_id string, risk_level string")
    tasks = spark.createDataFrame([("c",)], "transaction_id string")
    assert [r.transaction_id for r in outbox.enqueue_alerts(scored, tasks, now()).collect()] == ["a"]


def test_all_statuses_are_counted(spark):
    tasks = spark.createDataFrame([("a", "COMPLETED")], "transaction_id string, status string")
    assert {r.status: r.tasks for r in outbox.tasks_by_status(tasks).collect()} == {
        "PENDING_LLM": 0, "PENDING_EMAIL": 0, "COMPLETED": 1, "DEAD_LETTER": 0}


def test_top_contributions_rank_and_direction(spark):
    names = ["a", "b", "c"]
    arr = explain.as_contributions(names, [F.lit(1.0)] * 3, [F.lit(-0.5), F.lit(0.0), F.lit(0.5)])
    got = spark.range(1).select(explain.top_contributions(arr, 2).alias("x")).first().x
    assert [(x.feature_name, x.direction) for x in got] == [("a", "DECREASED_FRAUD_RISK"), ("c", "INCREASED_FRAUD_RISK")]


def test_mail_escapes_html(spark):
    assert value(spark, alerts.escape_html(F.col("s")), s='<b>&"') == "&lt;b&gt;&amp;&quot;"


def test_corrupt_messages_do_not_stop_the_reader(spark):
    df = spark.createDataFrame([('{"transactionId":"t","amount":1.5}',), ("{broken",), (None,)], "value string")
    good, bad = messages.parse_created(df)
    assert [r.transaction_id for r in good.collect()] == ["t"] and bad.count() == 2


def test_model_in_force_before_first_and_at_border(spark):
    d = datetime
    releases = spark.createDataFrame([("lgbm_a", d(2024, 1, 2)), ("other", d(2024, 1, 3)), ("lgbm_b", d(2024, 1, 5))], "object_name string, released_at timestamp_ntz")
    events = spark.createDataFrame([("1", d(2024, 1, 1)), ("2", d(2024, 1, 2)), ("3", d(2024, 1, 4)), ("4", d(2024, 1, 5)), ("5", d(2024, 2, 9))],
                                   "transaction_id string, creation_date_time timestamp_ntz")
    for limit in (2_000, 0):
        got = {r.transaction_id: r.model_version for r in registry.model_in_force(events, releases, small_registry=limit).collect()}
        assert got == {"1": None, "2": "lgbm_a", "3": "lgbm_a", "4": "lgbm_b", "5": "lgbm_b"}


def test_histogram_quantile_interpolates(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(at, 0.02)] * 6 + [(at, 0.3)] * 3 + [(at, 9.0)], "ts timestamp_ntz, s double")
    r = monitor.histogram_quantile(df, "ts", "s", [0.5, 0.99], length=1).first()
    assert r.p50 == pytest.approx(0.01 + 0.015 * 5 / 6) and r.p99 == 2.5


def test_task_keeps_its_record(spark):
    before = datetime(2024, 6, 14, 9, 0)
    tasks = spark.createDataFrame(
        [("done", "COMPLETED", 1, DUE, "p1", "old", before), ("due", "PENDING_EMAIL", 1, DUE, "p2", "old", None)],
        TASK + ", payload string, error_message string, completed_at timestamp_ntz")
    outcomes = spark.createDataFrame([("done", True, True, "m"), ("due", True, True, "m")], OUTCOME + ", mail string")
    got = {r.transaction_id: r for r in outbox.advance_tasks(tasks, outcomes, now()).collect()}
    assert (got["done"].completed_at, got["done"].payload, got["done"].error_message, got["done"].mail) == (before, "p1", "old", None)
    assert (got["due"].status, got["due"].payload, got["due"].error_message, got["due"].mail) == ("COMPLETED", "p2", None, "m")
    assert got["due"].completed_at == got["due"].last_attempt_at


@pytest.mark.parametrize("text,blank", [("\t", True), ("\n \r", True), (" ", True), ("", True), (None, True), (" a ", False), (" ", False)])
def test_blank_takes_all_white_space(spark, text, blank):
    from riskflow.functions.scalar import is_blank

    assert spark.createDataFrame([(text,)], "t string").select(is_blank(F.col("t")).alias("b")).first().b is blank
