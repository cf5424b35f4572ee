"""Keyset paging: where every row stands in a global order, without a one-task window.

The rows are range-partitioned and sorted by the order, numbered inside their range, and stored.
The ranges' sizes (one row per range) give each range its first position. A page is then a span
of positions, and the first row of each page is its key: page k is read by ``key >= first key``,
which a listing sorted by that key answers from file statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.session import materialize

#: Low bits of ``monotonically_increasing_id``: the row's place inside its task.
_PLACE = (1 << 33) - 1


def number_rows(df: DataFrame, order_by: Sequence[str | Column], position: str = "position") -> DataFrame:
    """``df`` plus ``position`` (long, gapless from 0) of every row in ``order_by`` order.

    Rows that ``order_by`` does not tell apart are ordered at random but get different positions,
    and may lie in several ranges, so a value shared by a third of all rows is no hot task. Each
    row is shuffled once; the result is stored in the checkpoint folder, so positions stay fixed.
    """
    if not order_by:
        raise ValueError("number_rows needs an order")
    if position in df.columns:
        raise ValueError(f"the input already has a column {position!r}")
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    by = [*order, F.col("_tie")]
    ranged = (df.withColumn("_tie", F.rand(17)).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie"))
    placed = materialize(ranged.withColumn("_range", F.spark_partition_id())
                         .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # At most one row per shuffle partition: small enough for one window and a broadcast.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return (placed.join(F.broadcast(firsts), "_range")
            .select(*df.columns, (F.col("_first") + F.col("_place")).alias(position)))


def running_totals(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str | Column], weight: str,
                   before: str = "before") -> DataFrame:
    """``df`` plus ``before``: the sum of ``weight`` over the rows of the same group that precede the row.

    A group may hold a third of all rows: it is cut into ranges of the order, summed inside each
    range, and the ranges' totals are added up. Null groups are groups too. Rows that ``order_by``
    does not tell apart follow each other in some fixed order.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    by = [*[F.col(g) for g in group_by], *order, F.col("_tie")]
    placed = materialize(df.withColumn("_tie", F.rand(19)).repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    ahead = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_range", *group_by).orderBy(*order, "_tie").rowsBetween(*ahead)
    # A group lies in several ranges only where it is large: one row per group and range.
    parts = placed.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_by)], F.col("_range").alias("_r")).agg(F.sum(weight).alias("_sum"))
    keys = [f"_g{i}" for i in range(len(group_by))]
    earlier = Window.partitionBy(*keys).orderBy("_r").rowsBetween(*ahead)
    parts = parts.select(*keys, "_r", F.sum("_sum").over(earlier).alias("_base")).where("_base is not null")
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group_by):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (placed.withColumn("_here", F.sum(weight).over(inside)).join(parts, same, "left")
            .select(*df.columns, (F.coalesce("_here", F.lit(0)) + F.coalesce("_base", F.lit(0))).alias(before)))


def page_rows(df: DataFrame, order_by: Sequence[str | Column], page_size: int,
              page: str = "page", slot: str = "slot") -> DataFrame:
    """``df`` plus the page (from 1) that holds each row and its slot (from 0) on that page."""
    if page_size < 1:
        raise ValueError("page_size must be at least 1")
    numbered = number_rows(df, order_by, "_position")
    return numbered.select(*df.columns, F.expr(f"_position div {int(page_size)} + 1").alias(page),
                           F.expr(f"_position % {int(page_size)}").alias(slot))


def page_keys(df: DataFrame, key: str, page_size: int) -> DataFrame:
    """``(page, first_key, last_key, n_rows)``: one row per page of a listing in ``key`` order."""
    paged = page_rows(df.select(key), [key], page_size)
    return (paged.groupBy("page").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"),
                                      F.count(F.lit(1)).alias("n_rows")))
