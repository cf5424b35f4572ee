"""Edge rows every fixture should survive: nulls, empty arrays, empty names, case twins."""

import os

from pyspark.sql import functions as F

from conftest import rows
from lakeops.operators import access, links, nested, paths, quality, search
from lakeops.sources import csv_to_table


def test_listing_with_nulls_and_empty_names(spark):
    df = spark.createDataFrame([(None, None, None, None), ("", False, False, None),
                                ("item/Tables//_delta_log", True, None, None), ("item/Tables/x", None, True, None)],
                               "name string, isDirectory boolean, isShortcut boolean, accountType string")
    assert paths.path_parts(df).count() == 4
    t = rows(paths.discover_tables(df), "name", "relativePath", "schema")
    assert t == [("", "Tables//", None)]  # empty table segment kept, as split('/') gives it
    assert paths.build_tree(paths.path_parts(df).where(F.col("relativePath").isNotNull())).count() == 3


def test_roles_with_null_and_empty_arrays(spark):
    ddl = ("id string, name string, decisionRules array<struct<effect:string, permission:array<struct<"
           "attributeName:string, attributeValueIncludedIn:array<string>>>>>, members struct<"
           "fabricItemMembers:array<struct<itemAccess:array<string>,sourcePath:string>>, "
           "microsoftEntraMembers:array<struct<tenantId:string,objectId:string,objectType:string>>>")
    roles = spark.createDataFrame([
        ("a", "a", None, None),
        ("b", "b", [], (None, None)),
        ("c", "c", [("Permit", None)], (None, [])),
        ("d", "d", [("Permit", [("Path", None), ("Path", ["x"])])], (None, [(None, None, None)])),
        ("e", "e", [("Permit", [("Path", [None, "x"])])], (None, None)),
    ], ddl)
    p = spark.createDataFrame([("x",), ("xy",)], "path string")
    # d: the first Path permission has no values, so the second one is ignored
    assert rows(access.roles_for_path(p, roles)) == [("e", "x"), ("e", "xy")]
    assert dict(rows(access.role_path_counts(p, roles))) == {"a": 0, "b": 0, "c": 0, "d": 0, "e": 2}
    assert access.roles_for_member(roles).count() == 0
    assert rows(access.access_summary(p, roles)) == []


def test_case_twins_percent_and_underscore_names(spark):
    tags = spark.createDataFrame([("1", "Ops_%", 1), ("2", "ops_%", 2), ("3", "OPS", 3), ("4", "", 4)],
                                 "id string, name string, ord int")
    req = spark.createDataFrame([("OPS_%",), ("ops",), ("",), (None,), ("o%",)], "name string")
    got = {r["name"]: r["match_id"] for r in links.resolve_names(tags, req).collect()}
    assert got == {"OPS_%": "2", "ops": "3", "": "4", None: None, "o%": None}
    assert rows(search.search_catalog(tags, [search.filter_contains("name", "S_%")]), "id") == [("1",), ("2",)]
    assert rows(search.delete_by_pattern(tags, "name", "_"), "id") == [("3",), ("4",)]


def test_shares_and_runs_with_nulls(spark):
    shares = spark.createDataFrame([("s1", None, "Active"), ("s2", [None, "p"], None), ("s3", [], "Pending")],
                                   "id string, paths array<string>, status string")
    p = spark.createDataFrame([("p",), (None,)], "path string")
    assert rows(links.shared_paths(p, shares)) == sorted([("p", False), (None, False)], key=repr)
    ops = spark.createDataFrame([("1", None, None, None)],
                                "id string, status string, percentComplete double, error struct<code:string,message:string>")
    r = quality.run_state_flags(spark.createDataFrame([("1",), (None,)], "id string"), ops).collect()
    assert len(r) == 2
    one = [x for x in r if x["id"] == "1"][0]
    assert (one["running"], one["complete"], one["failed"]) == (False, False, False)


def test_definitions_with_missing_parts(spark):
    items = spark.createDataFrame([("i1", "T", "n", None), ("i2", "T", "n", None)],
                                  "id string, type string, displayName string, description string")
    defs = spark.createDataFrame([("i1", None, None)], f"itemId string, format string, parts array<{nested.PART_TYPE}>")
    out = nested.unpack_definitions(items, defs).collect()
    assert all(r["definition"] is None and r["additionalParts"] == [] for r in out)


def test_csv_result_reads_staged_parquet_only(spark, tmpdir_new):
    os.makedirs(f"{tmpdir_new}/c")
    with open(f"{tmpdir_new}/c/a.csv", "w") as fh:
        fh.write("a,b\n1,x\n")
    out = csv_to_table(spark, f"{tmpdir_new}/c", "a int, b string")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in plan and "FileScan parquet" in plan
    assert rows(out) == [(1, "x")]


def test_operators_on_empty_input(spark):
    from test_access import ROLE_DDL
    empty_roles = spark.createDataFrame([], ROLE_DDL)
    empty_paths = spark.createDataFrame([], "path string")
    listing = spark.createDataFrame([], "name string, isDirectory boolean, isShortcut boolean, accountType string")
    folders = spark.createDataFrame([], "id string, displayName string, parentFolderId string")
    assert access.roles_for_path(empty_paths, empty_roles).count() == 0
    assert access.role_path_counts(empty_paths, empty_roles).count() == 0
    assert access.access_summary(empty_paths, empty_roles).count() == 0
    assert paths.discover_tables(listing).count() == 0
    assert paths.build_tree(paths.path_parts(listing)).count() == 0
    assert paths.tables_by_schema(paths.discover_tables(listing)).count() == 0
    from lakeops.operators import hierarchy
    assert hierarchy.folder_path(folders).count() == 0
    assert hierarchy.move_nodes(folders, spark.createDataFrame([], "id string, target string")).count() == 0
    tags = spark.createDataFrame([], "id string, name string, ord int")
    req = spark.createDataFrame([("x",)], "name string")
    assert [r["found"] for r in links.resolve_names(tags, req).collect()] == [False]
    assert search.first_match(tags, "name", "ord").count() == 0
    assert nested.load_page_dumps(spark.createDataFrame([], "page string")).count() == 0
