"""Ordered positions without single-task groups.

``sorted_blocks`` sorts with a range-partitioned sort (Spark samples the
sort keys, so a group holding a third of all rows is cut into many
balanced blocks), numbers rows inside each block and writes the result
once to the shared checkpoint folder, so every later reader sees the same
numbering (also after a lost executor). Per-block aggregates are a small
table; their prefix over blocks gives each block's offset. Rows with equal
sort keys cannot be split by a range sort, so callers pass an order that
ends in a unique column, or count equal rows first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def sorted_blocks(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """Rows sorted by (part, order); ``_blk`` = block, ``_mid`` increases by
    one per row inside a block."""
    b = (df.orderBy(*part, *order)
           .withColumn("_blk", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    return materialize(b, "sorted-blocks")


def prefix_before(table: DataFrame, keys: list[str], col: str, how: str, out: str) -> DataFrame:
    """Per key, the sum or max of ``col`` over all earlier blocks."""
    w = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    fn = F.sum if how == "sum" else F.max
    return table.withColumn(out, fn(col).over(w))


def rank_within(df: DataFrame, part: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """0-based position of every row inside its ``part`` group in ``order``;
    keeps ``_blk`` for block-wise follow-up windows."""
    b = sorted_blocks(df, part, order)
    stats = b.groupBy("_blk", *part).agg(F.count(F.lit(1)).cast("bigint").alias("_cnt"),
                                        F.min("_mid").alias("_first"))
    stats = prefix_before(stats, part, "_cnt", "sum", "_off")
    return (b.join(stats.select("_blk", *part, "_off", "_first"), ["_blk", *part])
             .withColumn(out, F.coalesce("_off", F.lit(0)).cast("bigint") + F.col("_mid") - F.col("_first"))
             .drop("_off", "_first", "_mid"))


def running_sum(df: DataFrame, part: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` per ``part`` in ``order`` over sorted blocks:
    per-block sums -> prefix over blocks -> window inside (block, part)."""
    b = sorted_blocks(df, part, order)
    sums = b.groupBy("_blk", *part).agg(F.sum(value).cast("bigint").alias("_s"))
    pre = prefix_before(sums, part, "_s", "sum", "_pre").select("_blk", *part, "_pre")
    wl = (Window.partitionBy("_blk", *part).orderBy("_mid")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (b.join(pre, ["_blk", *part])
             .withColumn(out, F.coalesce("_pre", F.lit(0)).cast("bigint") + F.sum(value).over(wl))
             .drop("_blk", "_mid", "_pre"))


def previous_value(df: DataFrame, part: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``lag(value)`` per ``part`` in ``order`` over sorted blocks: inside a
    block a block-local window; the first row of a block takes the last
    value of the nearest earlier block holding the group (small table)."""
    b = sorted_blocks(df, part, order)
    last = b.groupBy("_blk", *part).agg(F.max_by(value, "_mid").alias("_last"))
    w = Window.partitionBy(*part).orderBy("_blk")
    carry = last.withColumn("_carry", F.lag("_last").over(w)).select("_blk", *part, "_carry")
    wl = Window.partitionBy("_blk", *part).orderBy("_mid")
    return (b.join(carry, ["_blk", *part])
             .withColumn(out, F.coalesce(F.lag(value).over(wl), F.col("_carry")))
             .drop("_blk", "_mid", "_carry"))
