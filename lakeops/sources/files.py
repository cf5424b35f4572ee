"""Whole-file reads and one-file-per-row writes.

Reads use Spark's own ``binaryFile`` source, so they split across tasks by file. Writes go
through the ``lakefiles`` Python Data Source: every row ``(path, content)`` becomes one file below the root, created or truncated.
The root may be any URI that pyarrow's file systems know, or the ``s3a://`` and ``wasbs://`` form of
one, so executors write to the shared store. A file is written under a temporary hidden name and renamed into place, so a retried task
(after a lost executor) rewrites the same files and never leaves half-written ones.
"""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lakeops.functions.codec import b64_encode, try_b64_decode


class _Count(WriterCommitMessage):
    def __init__(self, files: int):
        self.files = files


def relative_path(path: str | None) -> str:
    """``path`` below the root; null paths and paths that leave the root are errors."""
    if path is None:
        raise ValueError("a row has no path")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"not a path below the root: {path!r}")
    return "/".join(parts)


def writer_uri(root: str) -> str:
    """``root`` as pyarrow names it: Hadoop's schemes for S3 and blob storage have other names there."""
    root = re.sub(r"^s3[an]://", "s3://", root)
    blob = re.match(r"^wasb(s?)://([^@/]+)@([^./]+)\.blob\.([^/]+)(.*)$", root)
    if blob:
        root = f"abfs{blob[1]}://{blob[2]}@{blob[3]}.dfs.{blob[4]}{blob[5]}"
    return root if "://" in root or root.startswith("file:") else os.path.abspath(root)


class _Writer(DataSourceWriter):
    """Writes through the file system that the root's URI names, from every executor."""

    def __init__(self, options):
        self.root = options["path"]

    def write(self, iterator):
        from pyarrow import fs
        system, root = fs.FileSystem.from_uri(writer_uri(self.root))
        n, made = 0, set()
        for row in iterator:
            target = f"{root.rstrip('/')}/{relative_path(row[0])}"
            folder, _, name = target.rpartition("/")
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            content = row[1]
            data = b"" if content is None else (content.encode("utf-8") if isinstance(content, str) else bytes(content))
            # Hidden from readers until it has its name.
            tmp = f"{folder}/_{uuid.uuid4().hex}.{name}.tmp"
            with system.open_output_stream(tmp) as out:
                out.write(data)
            system.move(tmp, target)
            n += 1
        return _Count(n)


class LakeFilesSource(DataSource):
    """``df.write.format("lakefiles").mode("overwrite").save(root)`` with columns
    ``path`` (relative to root) and ``content`` (string or binary)."""

    @classmethod
    def name(cls):
        return "lakefiles"

    def schema(self):
        return "path string, content binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def _relative(path: Column) -> Column:
    """``relative_path`` as an expression (what it refuses is left to the writer)."""
    return F.array_join(F.filter(F.split(path, "/", -1), lambda p: ~p.isin("", ".")), "/")


def _write_unique(df: DataFrame, root: str) -> None:
    """Write ``df(path, content)`` unless two rows would write one file; the input is computed once."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        twice = kept.groupBy(_relative(F.col("path")).alias("path")).count().where("count > 1").head(1)
        if twice:
            raise ValueError(f"several rows write {twice[0]['path']!r}")
        kept.write.format("lakefiles").mode("overwrite").save(root)
    finally:
        kept.unpersist()


def write_text_rows(df: DataFrame, root: str, path_col: str = "path",
                    content_col: str = "content") -> None:
    """One UTF-8 text file per row; empty or null content leaves an empty file. Null paths, paths
    out of the root and paths given twice are errors."""
    from lakeops.sources import register
    register(df.sparkSession)
    _write_unique(df.select(F.col(path_col).alias("path"), F.col(content_col).cast("string").alias("content")), root)


def write_binary_rows(df: DataFrame, root: str, path_col: str = "path",
                      payload_col: str = "payload") -> None:
    """One file per row from base64 payload text; a payload that is not base64 fails the
    row's task rather than writing garbage."""
    from lakeops.sources import register
    register(df.sparkSession)
    out = df.select(F.col(path_col).alias("path"),
                    F.coalesce(try_b64_decode(payload_col),
                               F.when(F.col(payload_col).isNull(), F.lit(b"").cast("binary")),
                               F.raise_error(F.concat(F.lit("not base64: "), F.col(path_col)))
                               ).alias("content"))
    _write_unique(out, root)


def _plain(uri: Column | str) -> Column | str:
    """A file's address without the differences between Spark's spellings of one local path."""
    return re.sub("^file:/+", "file:/", uri) if isinstance(uri, str) else F.regexp_replace(uri, "^file:/+", "file:/")


#: Partitions of a scan of whole files that one task reads at most. Spark counts every file as
#: 4 MB at least, so that a partition of small files holds 32 of them.
TASK_PARTITIONS = 32
#: Names of listed files that the JVM hands over at once.
LISTED_AT_ONCE = 10_000


def _whole_files(spark: SparkSession, path: str | list[str], recursive: bool, ignore_corrupt: bool = False) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
            .option("ignoreCorruptFiles", ignore_corrupt).load(path))


def _tasks(scan: DataFrame) -> int:
    """Number of tasks that read ``scan``: many small files a task, but enough tasks for all cores."""
    return max(8 * scan.sparkSession.sparkContext.defaultParallelism, -(-scan.rdd.getNumPartitions() // TASK_PARTITIONS))


def _listed(scan: DataFrame) -> DataFrame:
    """``path`` of all files that the index of ``scan`` lists.

    As ``scan.inputFiles()``, whose names take a call of the JVM each; here they come joined by line breaks,
    which an address never holds.
    """
    names = scan.sparkSession._jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(scan._jdf.inputFiles())
    blocks = (names.slice(i, i + LISTED_AT_ONCE).mkString("\n") for i in range(0, names.length(), LISTED_AT_ONCE))
    blocks = pa.table({"names": pa.array(blocks, pa.string())})
    unquoted = F.pandas_udf(lambda paths: paths.map(unquote), "string")
    return scan.sparkSession.createDataFrame(blocks).select(F.explode(F.split("names", "\n")).alias("path")).select(
        _plain(unquoted("path")).alias("path"))


def _empty_files(scan: DataFrame, tasks: int) -> DataFrame:
    """``path`` of the zero-length files that Spark's file index lists and its scans skip.

    The index (which Spark lists in parallel and holds on the driver for every scan) names all files; those
    that a scan gives no row for are empty. The scan reads no content.
    """
    seen = scan.select(_plain(F.col("path")).alias("path")).coalesce(tasks)
    return _listed(scan).join(seen, "path", "left_anti")


def read_text_files(spark: SparkSession, path: str | list[str], recursive: bool = True,
                    ignore_corrupt: bool = False, include_empty: bool = True) -> DataFrame:
    """``path, content``: each file's whole text. ``path`` is a file, a folder, a glob or a list of
    these, in any file system that Spark reads. Unreadable files fail the job unless
    ``ignore_corrupt`` (the reference returns empty text instead). Spark's scan skips
    empty files; ``include_empty`` adds them with ``""``."""
    scan = _whole_files(spark, path, recursive, ignore_corrupt)
    tasks = _tasks(scan)
    out = scan.select(F.col("_metadata.file_path").alias("path"), F.col("content").cast("string").alias("content")).coalesce(tasks)
    if include_empty:
        out = out.unionByName(_empty_files(scan, tasks).select("path", F.lit("").alias("content")))
    return out


def read_binary_files(spark: SparkSession, path: str | list[str], recursive: bool = True,
                      include_empty: bool = True) -> DataFrame:
    """``path, length, modificationTime, payload``: each file's bytes as one-line base64.
    ``path`` as in :func:`read_text_files`. ``include_empty`` adds the zero-length files that Spark's scan
    skips (their modificationTime is null: Spark's index names them only)."""
    scan = _whole_files(spark, path, recursive)
    tasks = _tasks(scan)
    out = scan.select("path", "length", "modificationTime", b64_encode("content").alias("payload")).coalesce(tasks)
    if include_empty:
        out = out.unionByName(_empty_files(scan, tasks).select(
            "path", F.lit(0).cast("long").alias("length"),
            F.lit(None).cast("timestamp").alias("modificationTime"), F.lit("").alias("payload")))
    return out


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's checkpoint folder."""
    from lakeops.session import checkpoint_dir
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{label}-{uuid.uuid4().hex}"
