"""Rows that used to be dropped, capped or answered wrongly."""

import subprocess
import sys

import pytest
from conftest import rows
from pyspark.sql import functions as F

import lakeops.sources as SRC
from lakeops.operators import hierarchy as H
from lakeops.operators import links as L
from lakeops.operators import nested as N
from lakeops.operators import quality
from lakeops.operators import search as Q
from lakeops.sources.files import relative_path
from lakeops.sources.shortcuts import shortcut_uri


def test_deep_trees_have_no_limit(spark):
    n = 40
    chain = spark.range(n).select(F.concat(F.lit("f"), "id").alias("id"), F.col("id").cast("string").alias("displayName"),
                                  F.when(F.col("id") > 0, F.concat(F.lit("f"), (F.col("id") - 1).cast("string"))).alias("parentFolderId"))
    assert H.folder_path(chain).agg(F.max("depth")).first()[0] == n


def test_a_walk_that_repeats_is_an_error(spark):
    e = spark.createDataFrame([("a", "x", "b"), ("b", "y", "a"), ("a", "z", None)], "id string, displayName string, parentFolderId string")
    with pytest.raises(RuntimeError, match="repeats"):
        H.folder_path(e)


def test_new_folder_ids_are_whole_digests(spark):
    none = spark.createDataFrame([], "id string, displayName string, parentFolderId string")
    created, _ = H.ensure_folder_paths(none, spark.createDataFrame([(1, ["a", "b"])], "request int, segments array<string>"))
    assert all(len(r.id) == len("folder-") + 64 for r in created.collect())


def test_a_move_to_a_missing_folder_is_rejected(spark):
    f = spark.createDataFrame([("a", "A", None), ("b", "B", "a")], "id string, displayName string, parentFolderId string")
    got = {r.id: (r.parentFolderId, r.moved, r.rejected) for r in
           H.move_nodes(f, spark.createDataFrame([("b", "nowhere"), ("a", None)], "id string, target string")).collect()}
    assert got == {"a": (None, True, False), "b": ("a", False, True)}


def test_patches_apply_one_after_the_other(spark):
    base = spark.createDataFrame([(1, True, "a")], "id int, enabled boolean, cfg string")
    two = spark.createDataFrame([(1, 1, False, None), (1, 2, None, "b")], "id int, o int, enabled boolean, cfg string")
    assert rows(L.patch_rows(base, two, "id", order_col="o")) == [(1, False, "b")]
    with pytest.raises(Exception, match="order column"):
        L.patch_rows(base, two.drop("o"), "id").collect()


def test_generated_names_are_free(spark):
    have = spark.createDataFrame([("p", "a", "t"), ("p", "a_5", "t"), ("p", "a_5_2", "t")], "path string, name string, target string")
    req = spark.createDataFrame([(5, "p", "a", "n"), (6, "p", "a", "n"), (7, "q", "a", "n")], "req_id int, path string, name string, target string")
    result, outcomes = L.apply_shortcut_requests(have, req, "GenerateUniqueName")
    assert {(r.req_id, r.name) for r in outcomes.collect()} == {(5, "a_5_3"), (6, "a_6"), (7, "a")}
    names = [(r.path, r.name) for r in result.collect()]
    assert len(names) == len(set(names)) == 6


def test_generated_names_do_not_meet_each_other(spark):
    have = spark.createDataFrame([("p", "a", "t"), ("p", "a_5", "t"), ("p", "b", "t")], "path string, name string, target string")
    req = spark.createDataFrame([("5", "p", "a", "n"), ("2", "p", "a_5", "n"), ("x", "p", "b", "n")],
                                "req_id string, path string, name string, target string")
    names = [(r.path, r.name) for r in L.apply_shortcut_requests(have, req, "GenerateUniqueName")[0].collect()]
    assert len(names) == len(set(names)) == 6


def test_missing_flags_and_orders(spark):
    d = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, f boolean")
    assert rows(Q.search_catalog(d, [Q.filter_flag("f", negate=True)]), "id") == [(2,), (3,)]
    o = spark.createDataFrame([("a", None, 1), ("b", 2, 2), ("b", None, 3)], "k string, o int, v int")
    assert rows(Q.first_match(o, "k", "o"), "key", "v") == [("a", 1), ("b", 2)]


def test_whole_values_and_blank_fields(spark):
    guid = "00000000-0000-0000-0000-000000000000"
    d = spark.createDataFrame([(guid,), (guid + "\n",)], "g string")
    got = quality.validate_rows(d, quality.manifest_rules({"g": "Guid"})).collect()
    assert [r.errors for r in got] == [[], ["g is not a valid Guid"]]
    names = spark.createDataFrame([("ok",), ("\t ",), ("Starter Pool\u00a0",), ("a\n",), ("x" * 65,)], "n string")
    assert [r[0] for r in names.select(quality.pool_name_valid("n")).collect()] == [True, False, False, False, False]


def test_workload_names_differ_only_in_case(spark):
    p = spark.createDataFrame([("k", "org.w")], "package string, workloadName string")
    i = spark.createDataFrame([("k", "f", "Org.W", "Org.W.T")], "package string, itemFile string, itemWorkloadName string, typeName string")
    j = spark.createDataFrame([], "package string, itemFile string, jobName string")
    assert quality.validate_prefix_chain(p, i, j).count() == 0


def test_parts_without_path_and_double_definitions(spark):
    items = spark.createDataFrame([("i", "t", "n", "d")], "id string, type string, displayName string, description string")
    parts = "array<struct<path:string,payload:string,payloadType:string>>"
    defs = spark.createDataFrame([("i", [(None, "eA==", "x")]), ("i", [("b", "eA==", "x"), (None, "eQ==", "x")])], f"itemId string, parts {parts}")
    out = N.unpack_definitions(items, defs).collect()
    assert len(out) == 1 and any(p.path is None for p in out[0].additionalParts)


def test_pages_that_are_not_json(spark):
    pages = spark.createDataFrame([('{"a": 1}',), ("oops",), (None,)], "page string")
    with pytest.raises(Exception, match="not JSON"):
        N.load_page_dumps(pages).collect()
    assert N.load_page_dumps(pages, skip_errors=True).count() == 1
    assert N.page_errors(pages).count() == 2


def test_file_paths(spark, tmpdir_new):
    for bad in (None, "../x", "a/../../x", "", "/"):
        with pytest.raises(ValueError):
            relative_path(bad)
    d = spark.createDataFrame([("a/x.txt", "hello"), ("b/y.txt", ""), ("c.txt", None)], "path string, content string")
    SRC.write_text_rows(d, f"file://{tmpdir_new}/out")
    back = SRC.read_text_files(spark, f"file://{tmpdir_new}/out")
    assert sorted(r.content for r in back.collect()) == ["", "", "hello"]  # empty files are there
    with pytest.raises(ValueError, match="several rows"):
        SRC.write_text_rows(d.unionByName(d), f"{tmpdir_new}/twice")
    with pytest.raises(Exception, match="no path"):
        SRC.write_text_rows(spark.createDataFrame([(None, "x")], "path string, content string"), f"{tmpdir_new}/none")


def test_shortcut_locations(spark):
    arm = "struct<location:string,subpath:string,bucket:string>"
    kinds = ("oneLake struct<workspaceId:string,itemId:string,path:string>", f"amazonS3 {arm}", f"adlsGen2 {arm}",
             f"googleCloudStorage {arm}", f"s3Compatible {arm}", f"azureBlobStorage {arm}")
    schema = "target struct<type:string," + ",".join(k.replace(" ", ":", 1) for k in kinds) + ">"

    def s3(loc, sub):
        return (("AmazonS3", None, (loc, sub, None), None, None, None, None),)

    d = spark.createDataFrame([s3("https://my.data.s3.us-west-2.amazonaws.com", "p/q"), s3("https://s3.eu-west-1.amazonaws.com/bkt", "/p"),
                               s3("https://b.s3.amazonaws.com", None), s3("/local/dir/", "x")], schema)
    assert [r[0] for r in d.select(shortcut_uri()).collect()] == ["s3a://my.data/p/q", "s3a://bkt/p", "s3a://b", "/local/dir/x"]


def test_csv_headers_and_line_breaks(spark, tmpdir_new):
    import pathlib
    for name, text in (("a", 'id,a,b\n1,"x\ny",2\n'), ("b", "id,b,a\n2,3,z\n"), ("c", "id,a,b\nq,x,2\n")):
        pathlib.Path(tmpdir_new, f"{name}.csv").write_text(text)
    out = SRC.csv_to_table(spark, tmpdir_new, "id int, a string, b int", multi_line=True)
    assert rows(out) == [(1, "x\ny", 2)]


def test_a_restarted_stream_goes_on(spark, tmpdir_new):
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from lakeops.session import get_session\n"
        "from lakeops.streaming.csv_ingest import csv_ingest_stream\n"
        "s = get_session('local[2]', conf={'spark.sql.shuffle.partitions': '2'})\n"
        "csv_ingest_stream(s, %r, 'a int', %r, %r, available_now=True).awaitTermination()\n"
        "print('ROWS', s.read.parquet(%r).count())\n")
    import pathlib
    root = str(pathlib.Path(__file__).resolve().parents[1])
    src = pathlib.Path(tmpdir_new, "in")
    src.mkdir()
    code %= (root, str(src), f"{tmpdir_new}/out", f"{tmpdir_new}/state", f"{tmpdir_new}/out")
    seen = []
    for i in (1, 2):
        (src / f"f{i}.csv").write_text("a\n1\n2\n")
        p = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
        seen.append([x for x in p.stdout.splitlines() if x.startswith("ROWS")])
    assert seen == [["ROWS 2"], ["ROWS 4"]]


def test_siblings_come_folders_first_by_name(spark):
    from lakeops.operators import paths as P
    files = spark.createDataFrame([("a/z", "z", False), ("a", "a", True), ("a/b", "b", True), ("a/c", "c", False),
                                   ("b.txt", "b.txt", False), ("a/b/x", "x", False), ("0", "0", True)],
                                  "relativePath string, name string, isDirectory boolean")
    got = [(r.parentPath, r.name) for r in P.build_tree(files).collect()]
    assert got == [(None, "0"), (None, "a"), (None, "b.txt"), ("a", "b"), ("a", "c"), ("a", "z"), ("a/b", "x")]
