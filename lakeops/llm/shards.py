"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters the records into buckets of a bounded size by a seeded hash (the exchange).
Pass 2 shuffles each bucket by a Fisher-Yates permutation of its positions
(``functions.shuffle``) and writes it. The buckets one after another are a random order of all
records; equal runs of that order are the shards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stage, text_of, work_folder

#: Bytes of records that one bucket is to hold.
BUCKET_BYTES = 4 << 20
#: Buckets whose counts are summed in one step of the two-step running total.
STRIDE = 1024


def _starts(counts: DataFrame) -> DataFrame:
    """First position of each bucket in the whole order: running totals in two steps."""
    coarse = counts.groupBy(F.col("stride")).agg(F.sum("n").alias("sum_n"))
    before = Window.orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select("stride", F.coalesce(F.sum("sum_n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("stride").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (counts.withColumn("inner_n", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(coarse, "stride").withColumn("first_pos", F.col("base") + F.col("inner_n")))


def write_shards(docs: DataFrame, n_shards: int = 16, seed: int = 20, path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all records in a seeded random order as ``n_shards`` shards; return the written table.

    Law ``rows``: shard sizes differ by one row at most. The result has the input's columns and
    shard, slot (0.. in each shard, without gaps); files lie under ``path/shard=K`` sorted by slot.

    Null ids and texts are ordinary records (a null text has size 0). Records equal in id and text
    are interchangeable: each gets its own slot. An empty table gives no files and an empty
    result. Input columns named shard or slot are written as in_shard and in_slot.
    """
    spark = docs.sparkSession
    for name in ("shard", "slot"):
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, f"in_{name}")
    path = path or work_folder(spark, "shards")
    record = F.struct(*[docs[c] for c in docs.columns]).alias("record")
    text = text_of(docs, text_col)
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0)).alias("b")).first()
    n_buckets = max(1, math.ceil(size["b"] / bucket_bytes))

    spot = F.xxhash64(F.lit(seed), docs[id_col], text)
    placed = docs.select(record, F.pmod(spot, F.lit(n_buckets)).alias("bucket"), spot.alias("spot"))
    counts = (placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("stride", F.floor(F.col("bucket") / STRIDE)))
    # One random permutation per bucket, written once so that every later read sees the same one.
    perms = stage(_starts(counts).select(
        "bucket", "first_pos", F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), seed).alias("perm")), "perms")

    order = Window.partitionBy("bucket").orderBy("spot")
    ranked = placed.repartition(max(parts(docs), 1), "bucket").withColumn("rank", F.row_number().over(order))
    pos = F.col("first_pos") + F.element_at("perm", F.col("rank"))
    n, s = F.lit(size["n"]), F.lit(n_shards)
    # Shard k takes positions ceil(k n / s) .. ceil((k + 1) n / s) - 1.
    shuffled = (ranked.join(perms, "bucket").withColumn("pos", pos)
                .withColumn("shard", F.expr(f"cast((pos * {n_shards}) div {max(1, size['n'])} as int)")))
    slot = F.col("pos") - F.expr(f"(shard * {size['n']}L + {n_shards - 1}) div {n_shards}")
    out = (shuffled.select("shard", slot.alias("slot"), "record")
           .sortWithinPartitions("shard", "slot").select("shard", "slot", "record.*"))
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
