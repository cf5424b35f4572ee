"""Line dedup over levelled sorted runs of line hashes.

A run is a table (key, n, frequent) in the shared folder, bucketed by key and sorted inside its
buckets: line hashes, in how many documents of the batch each was seen, and whether that made it
frequent. A new batch of lines is merge-joined with the runs: keys that are frequent already
are taken out (the anti join), the others get the counts of the runs on top of their own, and the
batch's keys become a run of level 0. Two runs of a level are merged into one of the next level,
so a key is rewritten once per level and a batch meets few runs. All these joins go bucket by
bucket: a run is never shuffled again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, stage, work_folder

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_RUN = "key BINARY, n BIGINT, frequent BOOLEAN"


class LineRuns:
    """The levelled runs under one shared folder. The driver holds only their names.

    A folder that holds runs already is opened again as it was left (with its own number of buckets).
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, path: str | None = None, buckets: int | None = None):
        self._spark, self._min_docs = spark, min_docs
        self._path = (path or work_folder(spark, "line-runs")).rstrip("/")
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._runs: dict[int, str] = {}  # at most one run for each level, by table name
        self._version = 0
        if path is not None:
            self._reopen()

    # -- the list of live runs, a new small table for each change

    def _reopen(self) -> None:
        fs_path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path}/live")
        if not fs_path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            return
        live = self._spark.read.parquet(f"{self._path}/live")
        last = live.agg(F.max("version").alias("v")).first()["v"]
        for r in live.filter(F.col("version") == last).collect():
            self._buckets, self._version = r["buckets"], r["version"] + 1
            if r["folder"]:
                self._runs[r["level"]] = self._table(r["folder"])

    def _save(self) -> None:
        rows = [(level, name.rsplit("_", 1)[1], self._buckets) for level, name in self._runs.items()] or [(0, None, self._buckets)]
        (self._spark.createDataFrame(rows, "level int, folder string, buckets int").coalesce(1)
         .write.parquet(f"{self._path}/live/version={self._version}"))
        self._version += 1

    def _table(self, folder: str) -> str:
        """A run's folder as a table, so that Spark knows its buckets."""
        name = f"line_run_{uuid.uuid4().hex[:8]}_{folder}"
        self._spark.sql(f"CREATE TABLE {name} ({_RUN}) USING parquet CLUSTERED BY (key) SORTED BY (key) "
                        f"INTO {self._buckets} BUCKETS LOCATION '{self._path}/{folder}'")
        return name

    def _write(self, run: DataFrame) -> str:
        name = self._table(uuid.uuid4().hex)
        run.select("key", "n", "frequent").write.insertInto(name, overwrite=True)
        return name

    # -- batches

    def _meet(self, counts: DataFrame) -> DataFrame:
        """``counts(key, n)`` with what the runs hold of each key; keys that are frequent already are left out."""
        before = F.lit(0).cast("long")
        for i, name in enumerate(self._runs.values()):
            run = self._spark.table(name).select("key", F.col("n").alias(f"_n{i}"), F.col("frequent").alias(f"_f{i}"))
            counts = counts.join(run.hint("merge"), "key", "left").filter(F.coalesce(F.col(f"_f{i}"), F.lit(False)) == F.lit(False))
            before = before + F.coalesce(F.col(f"_n{i}"), F.lit(0))
        return counts.select("key", "n", (F.col("n") + before >= self._min_docs).alias("frequent"))

    def add(self, keys: DataFrame) -> None:
        """Add a batch: ``keys(key)`` holds each document's distinct keys."""
        counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        run = self._write(self._meet(counts.repartition(self._buckets, "key")))
        level = 0
        while level in self._runs:
            older, a, b = self._runs.pop(level), "a", "b"
            x, y = self._spark.table(older).alias(a), self._spark.table(run).alias(b)
            merged = x.join(y.hint("merge"), F.col("a.key") == F.col("b.key"), "full").select(
                F.coalesce("a.key", "b.key").alias("key"),
                (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"),
                (F.coalesce("a.frequent", F.lit(False)) | F.coalesce("b.frequent", F.lit(False))).alias("frequent"))
            both = (older, run)
            run = self._write(merged)
            for name in both:
                self._spark.sql(f"DROP TABLE {name}")  # the table only: its files stay for whoever still reads them
            level += 1
        self._runs[level] = run
        self._save()

    def frequent(self) -> DataFrame:
        """Keys that all batches together saw in at least ``min_docs`` documents."""
        out = self._spark.createDataFrame([], "key binary")
        for name in self._runs.values():  # a key is marked in one run only: later batches leave it out
            out = out.unionByName(self._spark.table(name).filter("frequent").select("key"))
        return out

    def close(self) -> None:
        """Forget the table names; the folder can be opened again."""
        for name in self._runs.values():
            self._spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._runs = {}


def line_keys(text: Column, min_points: int) -> Column:
    """For every line its key, the MD5 of the trimmed, A-Z lower-cased line; null if that is under ``min_points`` code points."""
    lines = F.split(F.translate(text, UPPER, LOWER), "\n", -1)

    def key(line):
        line = F.btrim(line, F.lit(BLANKS))
        return F.when(F.length(line) >= max(1, min_points), F.unhex(F.md5(line.cast("binary"))))
    return F.transform(lines, key)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_points: int = 1, batches: int = 4,
                        id_col: str = "doc_id", text_col: str = "text", runs: LineRuns | None = None) -> DataFrame:
    """Take out, in every document, all lines whose key is found in at least ``min_docs`` documents.

    The documents enter ``runs`` in ``batches``; afterwards every line is judged against all runs
    (also those of earlier calls on the same ``runs``, whose ``min_docs`` then holds). Returns one
    row per input row: doc_id, n_lines (before), n_dropped, kept (the other lines joined by a line feed).

    A null or empty text is one empty line, and blank lines are never dropped: their key is
    shorter than one code point. Every row is a document of its own, also rows of one id, without
    id, or equal in everything. A line's repeats inside a document count once but all go. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    own = runs is None
    runs = runs or LineRuns(spark, min_docs)
    rows = numbered(docs, id_col, text_col, keys=line_keys(F.col("text"), min_points),
                    batch=F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches)))
    for i in range(batches):
        seen = rows.filter(F.col("batch") == i).select(F.explode(F.array_distinct("keys")).alias("key"))
        runs.add(seen.filter("key is not null"))
    # Stored, so that the join shuffles both sides and can split the rows of a very common line.
    frequent = stage(runs.frequent(), "frequent-lines")
    if own:
        runs.close()
    # The complement of the anti join: which positions go.
    lines = rows.select("row_key", F.posexplode("keys").alias("pos", "key")).filter("key is not null")
    gone = lines.join(frequent, "key", "left_semi").groupBy("row_key").agg(F.collect_set("pos").alias("gone"))
    out = rows.select("row_key", "doc_id", "text").join(gone, "row_key", "left").select(
        "doc_id", F.split("text", "\n", -1).alias("lines"), "gone")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    stay = F.transform(F.array_except(every, "gone"), lambda i: F.col("lines")[i])
    return out.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(stay, "\n")).alias("kept"))
