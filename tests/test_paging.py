"""Paging: positions against a plain sort, ties, one hot value, empty input."""

import random

import pytest
from pyspark.sql import functions as F

from lakeops.operators.paging import number_rows, page_keys, page_rows, running_totals


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_positions_match_a_sort(spark, partitions):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 2, 2, 9]), i) for i in range(500)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "k int, i long").repartition(5)
        got = {r.i: r.position for r in number_rows(df, [F.col("k").desc_nulls_last(), "i"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == {r[1]: n for n, r in enumerate(want)}


def test_ties_get_all_positions_and_spread(spark):
    df = spark.range(4000).select(F.lit("same").alias("k"))
    out = number_rows(df, ["k"])
    assert sorted(r.position for r in out.collect()) == list(range(4000))


def test_pages_and_keys(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(25)], "k long")
    pages = {r.k: (r.page, r.slot) for r in page_rows(df, ["k"], 10).collect()}
    assert pages[0] == (1, 0) and pages[27] == (1, 9) and pages[30] == (2, 0) and pages[72] == (3, 4)
    keys = sorted(tuple(r) for r in page_keys(df, "k", 10).collect())
    assert keys == [(1, 0, 27, 10), (2, 30, 57, 10), (3, 60, 72, 5)]


def test_empty_and_bad_arguments(spark):
    df = spark.createDataFrame([], "k long")
    assert number_rows(df, ["k"]).count() == 0
    assert page_keys(df, "k", 3).count() == 0
    with pytest.raises(ValueError):
        number_rows(df, [])
    with pytest.raises(ValueError):
        page_rows(df, ["k"], 0)


def test_running_totals_of_a_hot_group(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), i, rng.randint(0, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i long, w long").repartition(4)
    got = {r.i: r.before for r in running_totals(df, ["g"], [F.col("i").desc()], "w").collect()}
    assert got == {i: sum(w2 for g2, j, w2 in rows if g2 == g and j > i) for g, i, w in rows}
