"""K-d tree sharding: near-equal bytes, neighbours in metadata together.

Points are groups of equal texts, weighted by their bytes, with metadata as
dimensions. Level by level, every node that still holds more than one shard
is cut along its widest dimension (range over the node as a share of the
range over all points) at the distributed weighted median: points are sorted
by range partitions, partition sums give each block's offset, and a window
inside a block gives the weight before each point. Nodes with an odd number
of shards are cut in proportion, so leaves reach the target bytes (total
over shards). Only sums per node reach the driver's plan, none its memory.

A group of equal texts stays in one shard unless it is larger than a
shard's target; such a hot group is first dealt by a hash of doc_id into
parts of at most ``1 / HOT_PARTS`` of the target. All is DataFrame code.

Null text has size 8 (no bytes) and the CRC of the empty text, in a group
with empty text; repeated rows and ties each get a row and a slot of their
own; null metadata counts as 0; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import Stage

SHARDS = 24
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: A group above the target is dealt into parts of the target over this.
HOT_PARTS = 16


def measured(docs: DataFrame) -> DataFrame:
    """One narrow row per document: size, CRC, group and metadata codes."""
    text = F.coalesce("text", F.lit(""))
    code = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        code("source").alias("source"), code("lang").alias("lang"))


#: Dimensions of the tree; equal texts are one point in all of them.
DIMENSIONS = ("source", "lang", "size", "first_id")


def _points(rows: DataFrame, shards: int) -> DataFrame:
    """Groups of equal texts as points; ``part`` splits hot groups."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = max(total / shards, 1)
    groups = rows.groupBy("group", "size").agg(F.sum("size").alias("weight"))
    parts = F.when(F.col("weight") > target, F.ceil(F.col("weight") * HOT_PARTS / target)).otherwise(1)
    return groups.select("group", "size", parts.cast("int").alias("parts"))


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id"), parts).cast("int")


def running_weight(points: DataFrame) -> DataFrame:
    """Weight before each point of its node, in the order of (value, tie),
    without a node ever being in one task: a range-partitioned sort numbers
    blocks, block sums give offsets, and windows run inside blocks."""
    blocks = Stage(points.orderBy("node", "value", "tie").withColumn("block", F.spark_partition_id()), "kd-sorted").df
    sums = blocks.groupBy("node", "block").agg(F.sum("weight").alias("w"))
    earlier = Window.partitionBy("node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("node", "block", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("node", "block").orderBy("value", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return (blocks.join(F.broadcast(offsets), ["node", "block"])
                  .withColumn("before", F.col("offset") + F.coalesce(F.sum("weight").over(inside), F.lit(0)))
                  .drop("block", "offset"))


def kd_leaves(points: DataFrame, shards: int) -> DataFrame:
    """``points`` (group, size, part, weight, dimensions, tie) with ``shard``.
    A node is (first shard, number of shards); the number of nodes is at
    most the number of shards, so tables per node are broadcast."""
    # written, so that the node stays a join key and no constant
    now = Stage(points.withColumn("node", F.lit(0)).withColumn("leaves", F.lit(shards)), "kd-root").df
    spread = points.agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).first()
    left = shards
    while left > 1:
        left = -(-left // 2)
        width = [((F.max(d) - F.min(d)) / F.lit(max(spread[d] or 0, 1))).alias(f"w_{d}") for d in DIMENSIONS]
        nodes = now.groupBy("node").agg(F.sum("weight").alias("all"), *width)
        widest = F.greatest(*[f"w_{d}" for d in DIMENSIONS])
        axis = F.coalesce(*[F.when(F.col(f"w_{d}") == widest, F.lit(k)) for k, d in enumerate(DIMENSIONS)])
        nodes = nodes.select("node", "all", axis.alias("axis"))
        value = F.coalesce(*[F.when(F.col("axis") == k, F.col(d)) for k, d in enumerate(DIMENSIONS)])
        ordered = running_weight(now.join(F.broadcast(nodes), "node").withColumn("value", value))
        # low side: floor(leaves / 2) shards; the point on the cut goes where more of it lies
        low = F.floor(F.col("leaves") / 2)
        under = (F.col("leaves") > 1) & ((F.col("before") + F.col("weight") / 2) * F.col("leaves") <= F.col("all") * low)
        split = Stage(ordered.select(
            *points.columns,
            F.when(under | (F.col("leaves") == 1), F.col("node")).otherwise(F.col("node") + low).cast("int").alias("node"),
            F.when(F.col("leaves") == 1, F.lit(1)).when(under, low).otherwise(F.col("leaves") - low).cast("int").alias("leaves")),
            "kd-level")
        now = split.df
    return now.withColumnRenamed("node", "shard").drop("leaves")


def shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row. Slots run without
    gaps from 0 in each shard, by doc_id."""
    rows = Stage(measured(docs), "kd-rows").df
    parts = _points(rows, n)
    placed = rows.join(parts, ["group", "size"]).withColumn("part", _part(F.col("parts"))).drop("parts")
    placed = Stage(placed, "kd-placed").df
    keys = ["group", "size", "part"]
    points = Stage(placed.groupBy(*keys).agg(
        F.sum("size").alias("weight"), F.coalesce(F.min("doc_id"), F.lit(0)).alias("first_id"),
        F.coalesce(F.min_by("source", "doc_id"), F.lit(0)).alias("source"),
        F.coalesce(F.min_by("lang", "doc_id"), F.lit(0)).alias("lang"),
    ).withColumn("tie", F.xxhash64("group", "part")), "kd-points").df
    leaves = kd_leaves(points, n).select(*keys, "shard")
    out = placed.join(leaves, keys)
    return numbered(out.select("doc_id", "size", "text_crc32", "shard"))


def numbered(rows: DataFrame) -> DataFrame:
    """``slot``: 0, 1, 2 ... in each shard by doc_id, without one task per
    shard: numbers inside sorted blocks plus the rows of earlier blocks."""
    blocks = Stage(rows.orderBy("shard", "doc_id", "size", "text_crc32")
                       .withColumn("block", F.spark_partition_id())
                       .withColumn("at", F.monotonically_increasing_id()), "kd-slots").df
    counts = blocks.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return (blocks.join(F.broadcast(offsets), ["shard", "block"])
                  .withColumn("slot", (F.col("offset") + F.col("at") - F.col("first")).cast("bigint"))
                  .select(*rows.columns, "slot"))
