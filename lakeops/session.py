"""Session defaults and table registration.

The library never builds its own SparkSession inside an operator; callers pass one in.
``get_session`` is a convenience for scripts, tests and the bench.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Tables the driver writes under each scale-factor directory.
DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "lakeops",
                conf: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, or build one with the library defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**_DEFAULTS, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for staged data and checkpoints.

    On a cluster this is ``spark.checkpoint.dir`` as configured by the operator of the
    cluster; without it a cluster job stops with an error rather than write to a
    machine-local folder. Only in local mode with no setting (tests, the bench) do we
    pick a fresh local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster's "
                           "distributed file system); lakeops stages and checkpoints data there")
    d = tempfile.mkdtemp(prefix="lakeops-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(d)
    spark.conf.set("spark.checkpoint.dir", d)
    return spark.sparkContext.getCheckpointDir() or d


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    """Register each driver table as a temp view of the same name."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and store it in the checkpoint folder; later reads use the copy.

    Used where a small derived table feeds several branches of one plan, and between the
    levels of iterative walks, so lineage stays short and a lost executor recomputes one
    step. Never a machine-local checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    # Spark writes a reliable checkpoint with a second job that recomputes the plan; keep
    # the rows from the first (counting) job for it, then drop them once the files exist.
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = kept.checkpoint(eager=True)
    kept.unpersist()
    return out
