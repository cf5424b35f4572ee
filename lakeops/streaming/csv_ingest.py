"""``csv_to_table`` as a Structured Streaming job: keep a table in step with a CSV folder.

New files under ``source`` are picked up by the file stream source (its checkpoint
remembers which files were seen). Each micro-batch applies the same rule as the batch
operator: a file with any malformed row, or whose header names other columns or the same in another
order, is skipped whole, the others are appended.

Every micro-batch writes to folders named by its batch id with ``overwrite``, so a batch
replayed after a failure (lost executor, restarted driver) rewrites the same output
instead of appending twice. The output is Parquet partitioned by ``batch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from lakeops.sources.csv_table import CORRUPT, skip_bad_files, wrong_headers


def csv_ingest_stream(spark: SparkSession, source: str, schema: StructType | str, target: str,
                      checkpoint_location: str, delimiter: str = ",",
                      use_first_row_as_header: bool = True, max_files_per_trigger: int | None = None,
                      available_now: bool = False, processing_time: str | None = None
                      ) -> StreamingQuery:
    """Start the stream; returns the running query.

    ``checkpoint_location`` is a shared folder that a restarted stream is given again.

    ``available_now=True`` processes the files present now and stops (a scheduled
    catch-up run); otherwise it runs continuously, every ``processing_time`` if given.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    with_corrupt = StructType(list(schema.fields) + [StructField(CORRUPT, StringType())])
    ckpt = checkpoint_location.rstrip("/")
    rd = (spark.readStream.schema(with_corrupt).option("sep", delimiter)
          .option("header", use_first_row_as_header).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT))
    if max_files_per_trigger:
        rd = rd.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = rd.csv(source).withColumn("_file", F.col("_metadata.file_path"))
    stage_root = f"{ckpt}/stage"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        stage = f"{stage_root}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(stage)
        session = batch.sparkSession
        staged = session.read.parquet(stage)
        if use_first_row_as_header:  # of this batch's files, whose names the file source holds as well
            files = [r["_file"] for r in staged.select("_file").distinct().toLocalIterator()]
            if files:
                staged = staged.join(wrong_headers(session, files, schema, delimiter, False), "_file", "left_anti")
        good = skip_bad_files(staged, schema)
        good.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", f"{ckpt}/state")
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
