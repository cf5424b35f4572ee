"""``csv_to_table``: load a folder of CSV files into a table, skipping broken files.

Options follow the shortcut transform: ``delimiter``, ``useFirstRowAsHeader``,
``skipFilesWithErrors``. With skipping on, a file that has any row that does not fit the
schema (a value of the wrong type, a missing column) is left out *whole*; the other files
load.

Plan: one CSV scan in PERMISSIVE mode keeps each malformed row's text in a corrupt-record
column and tags rows with their file. Those rows are staged as Parquet in the cluster's
checkpoint folder (Spark refuses a query on the corrupt column of a raw CSV scan, and
staging also means the CSV is parsed once). The names of files with a corrupt row are a
small distinct set; an anti-join on them drops the bad files. No file is ever held by one
task as a whole, however large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakeops.sources.files import staging_path

CORRUPT = "_corrupt_record"


def _reader(spark: SparkSession, delimiter: str, header: bool, recursive: bool):
    return (spark.read.option("sep", delimiter).option("header", header)
            .option("recursiveFileLookup", recursive))


def header_schema(spark: SparkSession, source: str, delimiter: str = ",",
                  recursive: bool = True) -> StructType:
    """All-string schema named by the header line (no value inference, so a broken
    file's bad values can never decide a column type)."""
    cols = _reader(spark, delimiter, True, recursive).option("inferSchema", False).csv(source).columns
    return StructType([StructField(c, StringType()) for c in cols])


def wrong_headers(spark: SparkSession, source: str | list[str], schema: StructType, delimiter: str, recursive: bool) -> DataFrame:
    """``_file`` of every file whose header does not name the schema's columns in order.

    The header is the first line that is not blank, as for Spark's CSV reader, and is parsed by it:
    names may be quoted and hold the delimiter.
    """
    lines = (spark.read.option("recursiveFileLookup", recursive).text(source)
             .select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("at"),
                     F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "^\uFEFF", "").alias("value")))
    some = lines.where(F.trim("value") != "")
    first = some.groupBy("_file").agg(F.min_by("value", F.struct("at", "n")).alias("value"))
    names = [f.name for f in schema.fields]
    parsed = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names) + 1)), {"sep": delimiter})
    want = F.struct(*[F.lit(n).alias(f"c{i}") for i, n in enumerate([*names, None])])
    return first.where(~F.to_json(parsed).eqNullSafe(F.to_json(want))).select("_file")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through Spark's own file-system layer."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def skip_bad_files(staged: DataFrame, schema: StructType) -> DataFrame:
    """Rows of ``staged`` (with ``_file`` and the corrupt-record column) whose file has no
    malformed row. The bad file names are a small distinct set joined back."""
    bad = staged.where(F.col(CORRUPT).isNotNull()).select("_file").distinct()
    return staged.join(bad, "_file", "left_anti").select(*[f.name for f in schema.fields])


def csv_to_table(spark: SparkSession, source: str, schema: StructType | str | None = None,
                 delimiter: str = ",", use_first_row_as_header: bool = True,
                 skip_files_with_errors: bool = True, table: str | None = None,
                 recursive: bool = True, staging: str | None = None, multi_line: bool = False) -> DataFrame:
    """Rows of every usable CSV file under ``source`` (and ``saveAsTable(table)`` if given).

    ``schema`` is required unless there is a header; without one every column is text.
    With ``skip_files_with_errors=False`` a malformed row fails the load instead. A file whose
    header names other columns, or the same in another order, is a broken file. ``multi_line``
    allows line breaks inside quoted values; a file is then read by one task.
    The staged copy is removed once the table is saved (without ``table`` the result reads it).
    """
    if schema is None:
        if not use_first_row_as_header:
            raise ValueError("a schema is needed when the files have no header row")
        schema = header_schema(spark, source, delimiter, recursive)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    rd = _reader(spark, delimiter, use_first_row_as_header, recursive).option("multiLine", multi_line)
    if not skip_files_with_errors:
        # With enforceSchema off Spark itself compares each header with the schema.
        out = rd.schema(schema).option("enforceSchema", False).option("mode", "FAILFAST").csv(source)
    else:
        with_corrupt = StructType(list(schema.fields) + [StructField(CORRUPT, StringType())])
        raw = (rd.schema(with_corrupt).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", CORRUPT).csv(source)
               .withColumn("_file", F.col("_metadata.file_path")))
        stage = staging or staging_path(spark, "csv-stage")
        raw.write.mode("overwrite").parquet(stage)
        out = skip_bad_files(spark.read.parquet(stage), schema)
        if use_first_row_as_header:
            out = skip_bad_files(spark.read.parquet(stage).join(
                wrong_headers(spark, source, schema, delimiter, recursive), "_file", "left_anti"), schema)
    if table:
        out.write.mode("overwrite").saveAsTable(table)
        if skip_files_with_errors and staging is None:
            remove_folder(spark, stage)
        return spark.table(table)
    return out
