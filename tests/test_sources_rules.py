"""Readers on every kind of path, headers as the CSV reader parses them, overlapping mounts."""

import base64
import os

import pytest
from conftest import rows

import lakeops.sources as SRC
from lakeops.sources.files import writer_uri
from lakeops.streaming import csv_ingest_stream


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def names(df):
    return sorted((os.path.basename(r["path"]), r["content"]) for r in df.collect())


def test_text_files_of_any_path(spark, tmpdir_new):
    write(f"{tmpdir_new}/a b.txt", "one\ntwo")
    write(f"{tmpdir_new}/empty.txt", "")
    write(f"{tmpdir_new}/deep/er/ünï.txt", "three")
    write(f"{tmpdir_new}/deep/none %.txt", "")
    write(f"{tmpdir_new}/_hidden.txt", "")
    whole = [("a b.txt", "one\ntwo"), ("empty.txt", ""), ("none %.txt", ""), ("ünï.txt", "three")]
    assert [n for _, n in names(SRC.read_text_files(spark, tmpdir_new))] == [c for _, c in whole]
    assert names(SRC.read_text_files(spark, f"file://{tmpdir_new}", recursive=False))[-1] == ("empty.txt", "")
    assert names(SRC.read_text_files(spark, f"{tmpdir_new}/empty.txt")) == [("empty.txt", "")]
    assert [c for _, c in names(SRC.read_text_files(spark, f"{tmpdir_new}/a b.txt"))] == ["one\ntwo"]
    assert [c for _, c in names(SRC.read_text_files(spark, f"{tmpdir_new}/*.txt"))] == ["one\ntwo", ""]
    assert len(names(SRC.read_text_files(spark, [f"{tmpdir_new}/empty.txt", f"{tmpdir_new}/deep"]))) == 3


def test_binary_files_of_any_path(spark, tmpdir_new):
    write(f"{tmpdir_new}/x.bin", "xyz")
    write(f"{tmpdir_new}/e.bin", "")
    for path, n in ((tmpdir_new, 2), (f"{tmpdir_new}/*.bin", 2), (f"{tmpdir_new}/x.bin", 1), (f"{tmpdir_new}/e.bin", 1)):
        got = SRC.read_binary_files(spark, path).collect()
        assert len(got) == n and {base64.b64decode(r["payload"]) for r in got} <= {b"xyz", b""}


def test_writer_roots():
    assert writer_uri("s3a://b/x") == "s3://b/x"
    assert writer_uri("wasbs://c@acct.blob.core.windows.net/x/y") == "abfss://c@acct.dfs.core.windows.net/x/y"
    assert writer_uri("/a/b") == "/a/b" and writer_uri("file:/a") == "file:/a" and writer_uri("gs://b/x") == "gs://b/x"


@pytest.mark.parametrize("twin", ["a//b", "./a/b", "/a/b", "a/b"])
def test_two_spellings_of_one_path_are_an_error(spark, tmpdir_new, twin):
    df = spark.createDataFrame([("a/b", "1"), (twin, "2")], "path string, content string")
    with pytest.raises(ValueError, match="several rows"):
        SRC.write_text_rows(df, tmpdir_new)
    assert not os.path.exists(f"{tmpdir_new}/a")


def test_headers_as_the_reader_parses_them(spark, tmpdir_new):
    write(f"{tmpdir_new}/q.csv", '"a,x",b\n1,2\n')
    write(f"{tmpdir_new}/late.csv", '\n\n"a,x","b"\n3,4\n')
    write(f"{tmpdir_new}/more.csv", '"a,x",b,c\n5,6,7\n')
    write(f"{tmpdir_new}/swapped.csv", 'b,"a,x"\n8,9\n')
    write(f"{tmpdir_new}/bom.csv", '\ufeffa,x,b\n1,1,1\n')
    assert rows(SRC.csv_to_table(spark, tmpdir_new, "`a,x` int, b int")) == [(1, 2), (3, 4)]


def test_stream_skips_swapped_headers(spark, tmpdir_new):
    write(f"{tmpdir_new}/in/good.csv", "a,b\n1,2\n")
    write(f"{tmpdir_new}/in/swapped.csv", "b,a\n3,4\n")
    q = csv_ingest_stream(spark, f"{tmpdir_new}/in", "a int, b int", f"{tmpdir_new}/out", f"{tmpdir_new}/ck", available_now=True)
    q.awaitTermination(120)
    assert rows(spark.read.parquet(f"{tmpdir_new}/out"), "a", "b") == [(1, 2)]


def test_a_mount_has_what_it_has_alone(spark, tmpdir_new):
    spark.range(3).write.parquet(f"{tmpdir_new}/lake")
    spark.range(2).write.parquet(f"{tmpdir_new}/lake/sub")
    spark.range(4).write.parquet(f"{tmpdir_new}/other/p=1")
    arm = "struct<location:string,subpath:string,bucket:string,workspaceId:string,itemId:string,path:string>"
    kinds = ("oneLake", "amazonS3", "adlsGen2", "googleCloudStorage", "s3Compatible", "azureBlobStorage")
    schema = "path string, name string, target struct<type:string," + ",".join(f"{k}:{arm}" for k in kinds) + ">"

    def sc(name, sub):
        return ("Files", name, ("AmazonS3", None, (tmpdir_new, sub, None, None, None, None), None, None, None, None))

    def counts(*shortcuts):
        df = SRC.mount_shortcuts(spark, spark.createDataFrame(list(shortcuts), schema))
        return {r["shortcutName"]: r["count"] for r in df.groupBy("shortcutName").count().collect()}

    whole, sub = sc("whole", "/lake"), sc("sub", "/lake/sub")
    assert counts(whole) == {"whole": 3} and counts(sub) == {"sub": 2}
    assert counts(whole, sub, sc("again", "lake")) == {"whole": 3, "sub": 2, "again": 3}
    assert counts(sc("parts", "/other")) == {"parts": 4}
