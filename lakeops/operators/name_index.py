"""A stored trigram index over names: substring search that reads a few posting lists, not all names.

``build_name_index`` writes two Parquet tables. ``rows`` holds the listing with a number per row.
``postings`` has one row per trigram of the lower-cased names and block of 4,096 row numbers: which
of the block's rows hold it, as differences (so a trigram of most names is many small rows, not one
list). It is range-partitioned and sorted by trigram, so a search reads only the files and row groups
of its term's trigrams. ``search_names`` intersects the lists block by block and then tests the names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.functions.text import contains_text

#: Row numbers of a block are 2^12 neighbours.
BLOCK_BITS = 12


def build_name_index(df: DataFrame, name_col: str, path: str) -> None:
    """Write the index of ``df``'s ``name_col`` below ``path``, a new folder in a shared file system."""
    for c in ("_row", "_name"):
        if c in df.columns:
            raise ValueError(f"the input has a column {c!r}")
    root = path.rstrip("/")
    df.select("*", F.col(name_col).alias("_name"), F.monotonically_increasing_id().alias("_row")).write.parquet(f"{root}/rows")
    rows = df.sparkSession.read.parquet(f"{root}/rows")
    name = F.lower("_name")
    at = F.sequence(F.lit(1), F.length(name) - 2)
    grams = rows.where(F.length(name) >= 3).select(
        F.shiftright("_row", BLOCK_BITS).alias("block"), F.col("_row").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("at"),
        F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(name, i, F.lit(3))))).alias("gram"))
    lists = grams.groupBy("gram", "block").agg(F.array_sort(F.collect_list("at")).alias("ats"))  # 4,096 at most
    steps = F.transform("ats", lambda x, i: (x - F.when(i > 0, F.get("ats", i - 1)).otherwise(F.lit(0))).cast("short"))
    (lists.select("gram", "block", steps.alias("steps")).repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")
     .write.parquet(f"{root}/postings"))


def trigrams(spark: SparkSession, term: str) -> list[str]:
    """The distinct trigrams of a search term, lower-cased as the names are."""
    low = spark.range(1).select(F.lower(F.lit(term)).alias("t"), F.length(F.lower(F.lit(term))).alias("n"))
    grams = low.where("n >= 3").select(F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3)))).alias("g"))
    return sorted({r["g"] for r in grams.collect()})


def candidates(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """``_row`` of the names that hold all ``grams``."""
    lists = spark.read.parquet(f"{path.rstrip('/')}/postings").where(F.col("gram").isin(grams))
    # Differences back to places: running sums of at most 4,096 numbers.
    places = F.aggregate("steps", F.array().cast("array<int>"),
                         lambda acc, s: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + s))
    met = lists.select("block", places.alias("ats")).groupBy("block").agg(F.collect_list("ats").alias("all")).where(F.size("all") == len(grams))
    common = F.reduce(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), F.array_intersect)
    return met.select("block", F.explode(common).alias("at")).select(
        (F.shiftleft("block", BLOCK_BITS) + F.col("at")).alias("_row"))


def search_names(spark: SparkSession, path: str, term: str, case_sensitive: bool = False) -> DataFrame:
    """The listing's rows whose name contains ``term``, as ``filter_contains`` finds them.

    Terms of fewer than three characters have no trigram and read all names. Null names never match.
    """
    rows = spark.read.parquet(f"{path.rstrip('/')}/rows")
    grams = trigrams(spark, term)
    if grams:
        rows = rows.join(candidates(spark, path, grams), "_row", "left_semi")
    return rows.where(contains_text("_name", term, case_sensitive)).drop("_row", "_name")
