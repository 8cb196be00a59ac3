"""Connected components by alternating stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import Stage


def _rehang(edges: DataFrame, low_only: bool) -> DataFrame:
    """Hang neighbours on the least one. ``edges``: a, b with a > b.

    Large star (low_only false): every larger neighbour of a node moves to
    the least of the node and its neighbours. Small star: the node and its
    smaller neighbours move to the least of them. The least neighbour is a
    partial aggregate, so a node with very many edges is reduced before the
    shuffle, and the join back is one that Spark can split."""
    if low_only:
        both = edges
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = both.join(least, "a")
        out = out.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        out = out.select("e.a", "e.b")
    else:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge; the component is
    its least node. ``edges`` has columns a, b (any order, repeats and loops
    allowed, nulls dropped). An empty table gives an empty result."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) \
             .where("a <> b").distinct()
    now = Stage(e, "edges")
    seen = None
    while True:
        mark = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        step = Stage(_rehang(_rehang(now.df, low_only=False), low_only=True), "edges")
        now.drop()
        now = step
    star = now.df
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
