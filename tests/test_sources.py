import base64
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
import lakeops.sources as SRC
from lakeops.operators import paths as P


def make_lake(root):
    files = {
        "item/Tables/t1/_delta_log/0.json": "{}",
        "item/Tables/dbo/t2/_delta_log/0.json": "{}",
        "item/Tables/a/b/t3/_delta_log/0.json": "{}",
        "item/Files/x/y.txt": "hello",
        "item/Files/new/.folder_placeholder": "",
    }
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as fh:
            fh.write(text)
    os.symlink(os.path.join(root, "item/Files/x"), os.path.join(root, "item/Files/link"))


def test_list_paths_shows_hidden_and_feeds_discovery(spark, tmpdir_new):
    make_lake(tmpdir_new)
    listing = SRC.list_paths(spark, tmpdir_new, partitions=3)
    names = {r["name"]: r for r in listing.collect()}
    assert "item/Tables/t1/_delta_log" in names and names["item/Tables/t1/_delta_log"]["isDirectory"]
    assert "item/Files/new/.folder_placeholder" in names
    assert names["item/Files/x/y.txt"]["contentLength"] == 5
    assert names["item/Files/link"]["isShortcut"] and "item/Files/link/y.txt" not in names  # not followed
    assert len(names) == listing.count()  # every entry exactly once across partitions
    tables = rows(P.discover_tables(listing), "name", "schema")
    assert tables == sorted([("t1", None), ("t2", "dbo"), ("t3", None)], key=repr)
    top = rows(SRC.list_paths(spark, tmpdir_new, directory="item/Files", recursive=False), "name")
    assert top == [("item/Files/link",), ("item/Files/new",), ("item/Files/x",)]


def test_write_and_read_rows(spark, tmpdir_new):
    df = spark.createDataFrame([("a/one.txt", "héllo ✓"), ("a/empty.txt", ""), ("b/none.txt", None)],
                               "path string, content string")
    SRC.write_text_rows(df, tmpdir_new)
    SRC.write_text_rows(df.where("path = 'a/one.txt'").withColumn("content", F.lit("v2")), tmpdir_new)
    back = {os.path.basename(r["path"]): r["content"] for r in SRC.read_text_files(spark, tmpdir_new, include_empty=True).collect()}
    assert back == {"one.txt": "v2", "empty.txt": "", "none.txt": ""}
    raw = bytes(range(100))
    bdf = spark.createDataFrame([("bin/r.bin", base64.b64encode(raw).decode())], "path string, payload string")
    SRC.write_binary_rows(bdf, tmpdir_new)
    got = SRC.read_binary_files(spark, os.path.join(tmpdir_new, "bin")).collect()[0]
    assert base64.b64decode(got["payload"]) == raw and got["length"] == 100
    with pytest.raises(Exception):
        SRC.write_binary_rows(spark.createDataFrame([("bad.bin", "@@")], "path string, payload string"),
                              tmpdir_new)


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_csv_to_table_skips_whole_bad_files(spark, tmpdir_new):
    write(f"{tmpdir_new}/good.csv", "id,name,score\n1,a,1.5\n2,b,2.5\n")
    write(f"{tmpdir_new}/bad.csv", "id,name,score\n3,c,1.0\nx,d,2.0\n")        # wrong type
    write(f"{tmpdir_new}/short.csv", "id,name,score\n4,e,1.0\n5,f\n")         # missing column
    out = SRC.csv_to_table(spark, tmpdir_new, "id int, name string, score double")
    assert rows(out, "id") == [(1,), (2,)]
    keep = SRC.csv_to_table(spark, tmpdir_new, "id int, name string, score double",
                            skip_files_with_errors=False)
    with pytest.raises(Exception):
        keep.collect()


def test_csv_delimiter_header_options(spark, tmpdir_new):
    write(f"{tmpdir_new}/semi/a.csv", "k;v\n1;x\n2;y\n")
    assert rows(SRC.csv_to_table(spark, f"{tmpdir_new}/semi", delimiter=";"), "k", "v") == [("1", "x"), ("2", "y")]
    write(f"{tmpdir_new}/nohdr/a.csv", "1,x\n")
    out = SRC.csv_to_table(spark, f"{tmpdir_new}/nohdr", "k int, v string", use_first_row_as_header=False)
    assert rows(out) == [(1, "x")]
    with pytest.raises(ValueError):
        SRC.csv_to_table(spark, f"{tmpdir_new}/nohdr", None, use_first_row_as_header=False)


def test_mount_local_shortcut_and_page_dumps(spark, tmpdir_new):
    spark.range(5).write.parquet(f"{tmpdir_new}/data/t")
    write(f"{tmpdir_new}/pages/p1.json", '{"value": [{"a": 1}], "continuationToken": "n"}')
    write(f"{tmpdir_new}/pages/p2.json", '[{"a": 2}, {"a": 3}]')
    from lakeops.operators.nested import load_page_dumps
    items = load_page_dumps(SRC.read_page_dumps(spark, f"{tmpdir_new}/pages"))
    assert sorted(r[0] for r in items.select(F.variant_get("item", "$.a", "int")).collect()) == [1, 2, 3]
    df = SRC.mount_shortcut(spark, f"{tmpdir_new}/data/t", view="local_t")
    assert spark.sql("SELECT count(*) FROM local_t").collect()[0][0] == 5 and df.count() == 5


def test_mount_shortcuts_registers_local_targets(spark, tmpdir_new):
    spark.range(3).write.parquet(f"{tmpdir_new}/lake/a")
    spark.range(7).write.parquet(f"{tmpdir_new}/lake/b")
    T = ("struct<type:string, adlsGen2:struct<location:string,subpath:string,connectionId:string>,"
         "amazonS3:struct<location:string,subpath:string,connectionId:string>,"
         "externalDataShare:struct<connectionId:string>>")
    sc = spark.createDataFrame([
        ("Files", "sc_a", ("AdlsGen2", (f"file:{tmpdir_new}/lake", "/a", "c"), None, None)),
        ("Files", "sc_b", ("AmazonS3", None, (f"{tmpdir_new}/lake", "/b", "c"), None)),
        ("Files", "sc_x", ("ExternalDataShare", None, None, ("c",))),
    ], f"path string, name string, target {T}")
    # the URI rule only reads the arms a kind uses; missing arms are added as nulls
    for arm in ("oneLake", "googleCloudStorage", "s3Compatible", "azureBlobStorage"):
        sc = sc.withColumn("target", F.col("target").withField(
            arm, F.lit(None).cast("struct<location:string,subpath:string,bucket:string,"
                                  "workspaceId:string,itemId:string,path:string>")))
    sc = sc.unionByName(sc.where("name = 'sc_a'").withColumn("path", F.lit("Other")))
    got = {(r["shortcutPath"], r["shortcutName"]): r["count"] for r in
           SRC.mount_shortcuts(spark, sc).groupBy("shortcutPath", "shortcutName").count().collect()}
    # no storage location for the share; one name in two folders stays apart
    assert got == {("Files", "sc_a"): 3, ("Other", "sc_a"): 3, ("Files", "sc_b"): 7}


def test_csv_to_table_saves_a_table(spark, tmpdir_new):
    write(f"{tmpdir_new}/t/a.csv", "id,name\n1,a\n")
    write(f"{tmpdir_new}/t/b.csv", "id,name\nnope,b\n")
    out = SRC.csv_to_table(spark, f"{tmpdir_new}/t", "id int, name string", table="csv_loaded_t")
    assert rows(out) == [(1, "a")] and rows(spark.table("csv_loaded_t")) == [(1, "a")]
