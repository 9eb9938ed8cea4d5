"""What the physical plans must and must not hold."""

import re

import __spark_entry__ as entry
from riskflow.catalog.inputs import predictions, transactions
from riskflow.operators.history import ip_history
from riskflow.operators.velocity import velocity_features
from riskflow.sources.derived import table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_split_users_by_hour(spark):
    text = plan(velocity_features(transactions(spark, SF)))
    parts = re.findall(r"Window \[.*?\], \[(.*?)\], \[pos", text)
    assert parts and all("bucket" in p for p in parts)


def test_large_addresses_split_into_chunks(spark):
    text = plan(ip_history(transactions(spark, SF), predictions(spark, SF), max_group_rows=5))
    assert re.search(r"hashpartitioning\(ip_address#\d+, _chunk#\d+", text)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(table(spark, SF, "events").filter("event_type = 'error'").select("event_id"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in text
    text = plan(entry.queries()["d2_user_transaction_count"](spark, SF))
    assert "props" not in text


def test_the_curve_reads_its_input_once_and_needs_no_ceiling(spark, monkeypatch):
    """4,200 ranges: more than two steps of 64 pivots could tell apart."""
    from pyspark.sql import functions as F
    from riskflow.operators import evaluate, ordered

    reads = []
    written = ordered.written
    monkeypatch.setattr(evaluate, "written", lambda df, name: reads.append(name) or written(df, name))
    rows = spark.range(5_000).select((F.col("id") * 7919 % 4200 / 4200).alias("score"), (F.col("id") % 3 == 0).alias("is_fraud")).repartition(3)
    rows.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/curve-input")
    curve = evaluate.pr_curve(spark.read.parquet(path), "score", "is_fraud", max_group_rows=1)
    text = plan(curve)
    assert reads == ["curve"] and "curve-input" not in text and "CartesianProduct" not in text
    got = [tuple(r) for r in curve.orderBy(F.desc("threshold")).select("tp", "fp").collect()]
    want, tp, fp = [], 0, 0
    for r in rows.groupBy("score").agg(F.count_if("is_fraud").alias("p"), F.count_if(~F.col("is_fraud")).alias("n")).orderBy(F.desc("score")).collect():
        tp, fp = tp + r.p, fp + r.n
        want.append((tp, fp))
    assert got == want and len(got) == 4_200


def test_the_feature_vector_moves_its_rows_six_times(spark):
    """Ids twice for predictions, user, address, ids twice for the wide rows; lookups are broadcast as their size allows."""
    from pyspark.sql import functions as F
    from riskflow.catalog.inputs import dimensions, transaction_table
    from riskflow.plans.feature_vector import Dimensions, feature_vector

    d = dimensions(spark, SF)
    dims = Dimensions(*(F.broadcast(t) for t in (d.users, d.merchants, d.cards, d.devices)))
    tx, scored = transaction_table(spark, SF), predictions(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for modes in ({}, {"ttl_seconds": 600, "safe_only": True}):
            text = plan(feature_vector(tx, dims, scored, **modes))
            moved = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
            assert len([m for m in moved if "_known" not in m and "device_id" not in m]) <= 6, moved
            assert "CartesianProduct" not in text and "Python" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
