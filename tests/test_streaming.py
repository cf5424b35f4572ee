import os

from conftest import rows
from lakeops.streaming import csv_ingest_stream


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_csv_ingest_stream_appends_good_files_only(spark, tmpdir_new):
    src, out, ck = f"{tmpdir_new}/src", f"{tmpdir_new}/out", f"{tmpdir_new}/ck"
    write(f"{src}/a.csv", "id,v\n1,x\n2,y\n")
    write(f"{src}/b.csv", "id,v\nbad,z\n3,w\n")
    q = csv_ingest_stream(spark, src, "id int, v string", out, ck, available_now=True)
    q.awaitTermination(120)
    assert rows(spark.read.parquet(out), "id", "v") == [(1, "x"), (2, "y")]
    write(f"{src}/c.csv", "id,v\n4,q\n")  # a later file: only it is read on the next run
    q = csv_ingest_stream(spark, src, "id int, v string", out, ck, available_now=True)
    q.awaitTermination(120)
    assert rows(spark.read.parquet(out), "id", "v") == [(1, "x"), (2, "y"), (4, "q")]
