"""Every registered query beside its check SQL, over whole tables at the smallest scale."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows, types_differ

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


# Streams and models run their plans inside; contributions are the one Python step.
INSIDE = re.compile(r"(h[1-5]_|h9|h10|i\d|a1_|a5_pub|a6|g2)")
UNWANTED = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|Python|MapInPandas|ArrowEval")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if not INSIDE.match(name):
        assert not UNWANTED.search(df._jdf.queryExecution().executedPlan().toString())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got or name == "h5_late_rows"
        return
    rel = con.execute(ORACLES[name])
    assert not types_differ(df, rel)
    assert got == rows([d[0] for d in rel.description], rel.fetchall())


def test_entry_has_all_features(spark):
    assert len(entry.entry(spark).columns) == 32


def test_every_check_names_a_query():
    assert set(ORACLES) <= set(QUERIES)
