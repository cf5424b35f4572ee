"""Every registered query against its DuckDB oracle on the sf0.001 tables, plus plan checks."""

import duckdb
from pyspark.sql import functions as F
import pytest

import __spark_entry__ as E
from lakeops.plans import all_oracles, all_queries
from check_oracles import _rows
from conftest import SF001
from lakeops.session import DRIVER_TABLES

QUERIES = all_queries()  # those of the corpus operators are tested in tests/llm
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.columns == ["role_id", "n_paths"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries()) and set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    res = con.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, res.fetchall())


PY_EVAL = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_plans(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not any(p in plan for p in PY_EVAL), plan
    assert "CartesianProduct" not in plan


def _pushed(df):
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return " ".join(line for line in text.splitlines() if "PushedFilters" in line)


def test_condition_forms_reach_the_parquet_scan(spark):
    from lakeops.operators import search as Q
    part = spark.read.parquet(f"{SF001}/part.parquet")
    p = _pushed(Q.search_catalog(part, [Q.filter_contains("p_name", "ing", case_sensitive=True),
                                        Q.filter_roles_in("p_type", ["PROMO", "SMALL"])]))
    assert "StringContains(p_name,ing)" in p and "In(p_type" in p
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    p = _pushed(Q.search_catalog(orders, [Q.filter_expired("o_orderdate", "1997-01-01 00:00:00")]))
    assert "LessThan(o_orderdate" in p
    labels = spark.read.parquet(f"{SF001}/labels.parquet").select(
        "doc_id", (F.col("quality") == 1).alias("isQuality"))
    assert "EqualTo(quality,1)" in _pushed(Q.search_catalog(labels, [Q.filter_flag("isQuality")]))
