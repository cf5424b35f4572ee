"""Many small files: few tasks, few calls of the JVM, every file once."""

import os
from urllib.parse import unquote

import pytest

import lakeops.sources as SRC
from lakeops.sources import files


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    root = tmp_path_factory.mktemp("many")
    for i in range(2000):
        folder = root / f"d{i % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"f {i}%.txt").write_text("" if i % 7 == 0 else f"é{i}\n")
    return str(root)


def test_small_files_share_tasks(spark, lake):
    most = 8 * spark.sparkContext.defaultParallelism
    for df in (SRC.read_text_files(spark, lake, include_empty=False), SRC.read_binary_files(spark, lake, include_empty=False)):
        assert df.rdd.getNumPartitions() <= most  # one for 32 files before


def test_names_come_in_blocks(spark, lake, monkeypatch):
    client, calls = spark.sparkContext._gateway._gateway_client, []
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **k: calls.append(1) or send(*a, **k))
    df = SRC.read_text_files(spark, lake)
    assert len(calls) < 1500  # a call for each file before
    monkeypatch.undo()
    got = {unquote(os.path.basename(r["path"])): r["content"] for r in df.collect()}
    assert df.count() == 2000
    assert got == {f"f {i}%.txt": "" if i % 7 == 0 else f"é{i}\n" for i in range(2000)}


@pytest.mark.parametrize("block", [1, 7, 286])
def test_blocks_of_names_lose_none(spark, lake, monkeypatch, block):
    monkeypatch.setattr(files, "LISTED_AT_ONCE", block)
    scan = files._whole_files(spark, f"{lake}/d0", True)
    listed = [r["path"] for r in files._listed(scan).collect()]
    assert len(listed) == len(set(listed)) == 667
    empty = files._empty_files(scan, 4).collect()
    assert {os.path.basename(r["path"]) for r in empty} == {f"f {i}%.txt" for i in range(0, 2000, 21)}


def test_a_folder_without_files(spark, tmpdir_new):
    assert SRC.read_text_files(spark, tmpdir_new).collect() == []
    assert SRC.read_binary_files(spark, tmpdir_new).collect() == []
