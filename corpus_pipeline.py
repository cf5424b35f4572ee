"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm import decontaminate, exact, neardup, packing, quality, queries
from lakeops.llm.common import stage, text_of
from lakeops.session import read_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least GOOD stay."""
    model = queries.quality_model(spark, docs, sf_dir)
    if model is None:  # nothing to learn from, nothing to reject by
        return docs
    scored = quality.score(docs, model[0], out_col="_quality")
    return scored.filter(F.col("_quality") >= queries.GOOD).select(docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of each row's own, stored: ids may repeat or lack."""
    return stage(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts stays: the one with the longest text, then the first."""
    rows = _numbered(docs)
    keep = exact.exact_groups(rows, id_col="_row").filter("kept").select(F.col("doc_id").alias("_row"))
    return rows.join(keep, "_row", "left_semi").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: five-word shingles, similarity 0.8."""
    rows = _numbered(docs)
    gone = neardup.near_duplicates(rows, k=5, percent=80, id_col="_row").filter("not kept").select(F.col("doc_id").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap with no benchmark item stay; others of the same id, or also without one, are no matter."""
    rows = _numbered(docs)
    own = rows.select(F.col("_row").alias("row_key"), "doc_id", text_of(rows).alias("text"))
    hits = decontaminate.row_overlaps(own, read_table(spark, sf_dir, "benchmark")).select(F.col("row_key").alias("_row")).distinct()
    return rows.join(hits, "_row", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token pieces of sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Training the classifier, MinHash and packing have no SQL form; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
