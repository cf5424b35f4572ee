"""The trigram index against the plain condition."""

import random

from conftest import rows
from lakeops.operators import name_index as I
from lakeops.operators.search import filter_contains


def test_search_equals_the_scan(spark, tmpdir_new):
    rng = random.Random(2)
    bits = ["red", "Re", "dish", "%", "_", "É", "é", "blue", " ", "a", "aa", "İx", "日本語", ""]
    data = [(i, rng.choice([None] + 9 * ["".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))])) for i in range(6000)]
    df = spark.createDataFrame(data, "id long, name string").repartition(3)
    I.build_name_index(df, "name", f"{tmpdir_new}/ix")
    for term in ("red", "RED", "", "a", "aaa", "%_", "édish", "日本語", "nothing here", "İx", "redredred", "bluered"):
        for case in (False, True):
            want = rows(df.where(filter_contains("name", term, case)))
            assert rows(I.search_names(spark, f"{tmpdir_new}/ix", term, case)) == want, (term, case)


def test_a_search_reads_its_trigrams_only(spark, tmpdir_new):
    df = spark.range(20_000).selectExpr("id", "concat('name ', id, ' of ', id * 7919 % 1000003) AS name")
    I.build_name_index(df, "name", f"{tmpdir_new}/ix")
    found = I.candidates(spark, f"{tmpdir_new}/ix", I.trigrams(spark, "e 12345"))
    plan = found._jdf.queryExecution().toString()
    assert "In(gram" in plan.split("PushedFilters")[1]
    assert 1 <= found.count() < 60
    assert rows(I.search_names(spark, f"{tmpdir_new}/ix", "e 12345"), "id") == [(12345,)]


def test_empty(spark, tmpdir_new):
    I.build_name_index(spark.createDataFrame([], "id long, name string"), "name", f"{tmpdir_new}/ix")
    assert I.search_names(spark, f"{tmpdir_new}/ix", "abc").count() == 0
