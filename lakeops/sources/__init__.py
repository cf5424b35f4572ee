
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.sources.csv_table import csv_to_table, header_schema  # noqa: F401
from lakeops.sources.files import (  # noqa: F401
    read_binary_files,
    read_text_files,
    staging_path,
    write_binary_rows,
    write_text_rows,
)
from lakeops.sources.shortcuts import mount_shortcut, mount_shortcuts, shortcut_uri  # noqa: F401

_REGISTERED: set[int] = set()


def register(spark: SparkSession) -> None:
    """Register the ``lakepaths`` reader and ``lakefiles`` writer with this session.

    The two modules are pickled by value, so executors need not have the package
    installed to run them.
    """
    if id(spark) in _REGISTERED:
        return
    from pyspark import cloudpickle

    from lakeops.sources import files, listing
    cloudpickle.register_pickle_by_value(listing)
    cloudpickle.register_pickle_by_value(files)
    spark.dataSource.register(listing.LakePathsSource)
    spark.dataSource.register(files.LakeFilesSource)
    _REGISTERED.add(id(spark))


def list_paths(spark: SparkSession, root: str, directory: str = "", recursive: bool = True,
               partitions: int | None = None) -> DataFrame:
    """A ``paths`` listing of ``root/directory``, hidden names included."""
    register(spark)
    rd = spark.read.format("lakepaths").option("directory", directory).option("recursive", recursive)
    if partitions:
        rd = rd.option("partitions", partitions)
    return rd.load(root)


def read_page_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Landed response pages, one JSON document per file, as ``file, page`` rows."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("page"))
