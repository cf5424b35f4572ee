import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from lakeops.operators import quality
from lakeops.operators import search as Q


@pytest.fixture()
def names(spark):
    return spark.createDataFrame(
        [(1, "Sales_2024", "A"), (2, "100% Done", "b"), (3, "sales", None), (4, None, "a"),
         (5, "", "B"), (6, "Sälë", "c")], "id int, name string, grp string")


def test_contains_is_literal_and_case_insensitive(spark, names):
    ids = lambda df: sorted(r[0] for r in df.select("id").collect())
    assert ids(Q.search_catalog(names, [Q.filter_contains("name", "SALES")])) == [1, 3]
    assert ids(Q.search_catalog(names, [Q.filter_contains("name", "_")])) == [1]   # not a wildcard
    assert ids(Q.search_catalog(names, [Q.filter_contains("name", "%")])) == [2]   # not a wildcard
    assert ids(Q.search_catalog(names, [Q.filter_contains("name", "")])) == [1, 2, 3, 5, 6]  # null never
    assert ids(Q.search_catalog(names, [Q.filter_contains("name", "sales", case_sensitive=True)])) == [3]
    assert ids(Q.search_catalog(names, [Q.filter_contains("name", "SÄL")])) == [6]


def test_equals_ci_roles_in_and_flags(spark, names):
    ids = lambda df: sorted(r[0] for r in df.select("id").collect())
    assert ids(Q.search_catalog(names, [Q.filter_equals_ci("grp", "a")])) == [1, 4]
    assert ids(Q.search_catalog(names, [Q.filter_roles_in("grp", [])])) == [1, 2, 3, 4, 5, 6]
    assert ids(Q.search_catalog(names, [Q.filter_roles_in("grp", ["b", "c"])])) == [2, 6]
    flags = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, f boolean")
    assert ids(Q.search_catalog(flags, [Q.filter_flag("f")])) == [1]
    assert ids(Q.search_catalog(flags, [Q.filter_flag("f", negate=True)])) == [2, 3]


def test_expired_array_and_struct_filters(spark):
    df = spark.createDataFrame(
        [("a", "2020-01-01T00:00:00", ["x/y", "z"], ("u@x", "t1")),
         ("b", None, [], ("v@x", None)),
         ("c", "not a date", None, None),
         ("d", "2999-01-01T00:00:00", ["x/yy"], ("u@x", "t2"))],
        "id string, exp string, paths array<string>, recipient struct<upn:string,tenant:string>")
    ids = lambda conds: sorted(r[0] for r in Q.search_catalog(df, conds).select("id").collect())
    assert ids([Q.filter_expired("exp", dt.datetime(2024, 1, 1))]) == ["a"]
    assert ids([Q.filter_array_any("paths", "x/y")]) == ["a"]
    assert ids([Q.filter_array_any("paths", "x/y", how="contains")]) == ["a", "d"]
    assert ids([Q.filter_struct_field("recipient.upn", "u@x")]) == ["a", "d"]


def test_union_kind(spark):
    df = spark.createDataFrame(
        [("s1", ("OneLake", ("i", "w"), None)), ("s2", ("AmazonS3", None, ("loc",))), ("s3", None)],
        "name string, target struct<type:string, oneLake:struct<itemId:string,workspaceId:string>,"
        "amazonS3:struct<location:string>>")
    assert rows(Q.search_catalog(df, [Q.filter_union_kind("target", "OneLake")]), "name") == [("s1",)]
    assert rows(Q.search_catalog(df, [Q.filter_union_kind("target", "S3")]), "name") == [("s2",)]
    with pytest.raises(ValueError):
        Q.filter_union_kind("target", "Dataverse")


def test_delete_first_limit(spark, names):
    assert sorted(r[0] for r in Q.delete_by_pattern(names, "name", "SALE").select("id").collect()) == [2, 4, 5, 6]
    first = rows(Q.first_match(names, F.lower("grp"), "id"), "key", "id")
    assert first == sorted([(None, 3), ("a", 1), ("b", 2), ("c", 6)], key=repr)
    req = names.sparkSession.createDataFrame([("A",), ("zz",)], "name string")
    found = rows(Q.find_first(names, req.select(F.lower("name").alias("name")), F.lower("grp"), "id"), "key", "id")
    assert found == [("a", 1), ("zz", None)]
    assert Q.limit_rows(names, 0, ["id"]).count() == 6
    assert [r[0] for r in Q.limit_rows(names, 2, [F.desc("id")]).select("id").collect()] == [6, 5]
    with pytest.raises(ValueError):
        Q.limit_rows(names, 2, [])


def test_bucket_by_prefix(spark):
    df = spark.createDataFrame([("F64",), ("P1",), ("A2",), ("f2",), (None,), ("X",)], "sku string")
    got = dict((r[0], r[1]) for r in quality.bucket_by_prefix(df, "sku").collect())
    assert got == {"F64": "Fabric", "P1": "Premium", "A2": "Azure", "f2": "Unknown", None: "Unknown",
                   "X": "Unknown"}


def test_run_state_flags(spark):
    ops = spark.createDataFrame(
        [("1", "Running", 10.0, None), ("2", "Failed", None, ("E", "")), ("3", "Failed", None, ("E", "boom")),
         ("4", "Succeeded", 100.0, None), ("5", "NotStarted", None, None)],
        "id string, status string, percentComplete double, error struct<code:string,message:string>")
    req = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("5",), ("404",)], "id string")
    got = {r["id"]: r for r in quality.run_state_flags(req, ops).collect()}
    assert got["1"]["running"] and not got["1"]["complete"] and got["1"]["percent"] == 10.0
    assert got["2"]["failed"] and got["2"]["error_message"] == "Operation failed"
    assert got["3"]["error_message"] == "boom"
    assert got["4"]["succeeded"] and got["4"]["complete"] and got["4"]["error_message"] is None
    assert got["5"]["running"]
    m = got["404"]
    assert (m["running"], m["complete"], m["succeeded"], m["failed"], m["percent"]) == (False, True, False, False, None)
    runs = spark.createDataFrame([("a", "InProgress"), ("b", "Completed")], "id string, status string")
    assert rows(quality.runs_to_cancel(runs)) == [("a",)]


def test_validate_rows(spark):
    df = spark.createDataFrame(
        [("ok pool", "Small", (1, 3), (1, 2), 60, 3, "gw", "1.2.3", "0f8fad5b-d9cb-469f-a165-70867728950e"),
         ("Starter Pool", None, (0, 0), (3, 1), 45, 8, "x" * 201, "01.2.3", "nope"),
         ("", "Small", None, None, None, 0, "g", "1.0.0-beta.1+b.2", None)],
        "name string, nodeSize string, autoScale struct<minNodeCount:int,maxNodeCount:int>,"
        "dynamicExecutorAllocation struct<minExecutors:int,maxExecutors:int>,"
        "inactivityMinutesBeforeSleep int, numberOfMemberGateways int, displayName string,"
        "version string, guid string").withColumn("nodeFamily", F.lit("MemoryOptimized"))
    rules = (quality.pool_rules() + quality.gateway_rules()
             + quality.manifest_rules({"version": "SchemaVersion", "guid": "Guid"}))
    out = [r["errors"] for r in quality.validate_rows(df, rules).orderBy(F.length("name").desc()).collect()]
    assert out[0] == ["Node size is required", "Invalid pool name", "Minimum node count must be at least 1",
                      "Maximum node count must be at least 1",
                      "Minimum executors cannot be greater than maximum executors",
                      quality.GATEWAY_MESSAGES[0], quality.GATEWAY_MESSAGES[1], quality.GATEWAY_MESSAGES[2],
                      "version is not a valid SchemaVersion", "guid is not a valid Guid"]
    assert out[1] == []
    assert out[2] == ["Pool name is required", "Auto scale configuration is required",
                      "Dynamic executor allocation configuration is required", "Invalid pool name"]


def test_validate_prefix_chain(spark):
    pk = spark.createDataFrame([("p", "Org.W")], "package string, workloadName string")
    items = spark.createDataFrame([("p", "a.xml", "Org.W", "Org.W.Item"), ("p", "b.xml", "Org.X", "org.W.B")],
                                  "package string, itemFile string, itemWorkloadName string, typeName string")
    jobs = spark.createDataFrame([("p", "a.xml", "Org.W.Item.Job"), ("p", "a.xml", "Org.W.ItemJob")],
                                 "package string, itemFile string, jobName string")
    got = rows(quality.validate_prefix_chain(pk, items, jobs), "subject")
    assert got == sorted([("Org.W.ItemJob",), ("b.xml",), ("org.W.B",)], key=repr)


def test_run_state_flags_latest_state_per_operation(spark):
    ops = spark.createDataFrame(
        [("1", "Running", 10.0, None, "2024-01-01 00:00:00"), ("1", "Succeeded", 100.0, None, "2024-01-01 00:05:00")],
        "id string, status string, percentComplete double, error struct<code:string,message:string>, "
        "lastUpdatedTimeUtc string").withColumn("lastUpdatedTimeUtc", F.col("lastUpdatedTimeUtc").cast("timestamp"))
    r = quality.run_state_flags(spark.createDataFrame([("1",)], "id string"), ops).collect()
    assert len(r) == 1 and r[0]["succeeded"] and r[0]["percent"] == 100.0


def test_random_text_conditions_match_js_includes(spark):
    import random
    rnd = random.Random(11)
    alphabet = ["a", "A", "%", "_", ".", "*", "\\", "é", "É", "["]
    vals = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 5))) for _ in range(80)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v string")
    for term in ["", "a", "A%", "_", ".*", "\\", "É", "[a"]:
        ids = lambda conds: sorted(r[0] for r in Q.search_catalog(df, conds).select("id").collect())
        assert ids([Q.filter_contains("v", term)]) == [i for i, v in enumerate(vals)
                                                       if v is not None and term.lower() in v.lower()], term
        assert ids([Q.filter_contains("v", term, case_sensitive=True)]) == [
            i for i, v in enumerate(vals) if v is not None and term in v], term
        assert ids([Q.filter_equals_ci("v", term)]) == [i for i, v in enumerate(vals)
                                                        if v is not None and v.lower() == term.lower()], term
        kept = sorted(r[0] for r in Q.delete_by_pattern(df, "v", term).select("id").collect())
        assert kept == [i for i, v in enumerate(vals) if v is None or term.lower() not in v.lower()], term
