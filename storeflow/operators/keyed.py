"""Keyed catalog operators: lookup, exists, missing, upsert.

All are equi-joins or keyed aggregations; Catalyst picks broadcast-hash
joins only from size statistics, and AQE splits skewed join partitions at
run time. The last-write-per-key step is an aggregation (``max_by``)
rather than a window, so it combines map-side and a key holding a third
of all updates is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S


def lookup(requests: DataFrame, products: DataFrame, *, req_key: str = "product_id",
           key: str = "product_id") -> DataFrame:
    """Left join requests to products; ``found`` flag and NOT_FOUND error."""
    p = products.withColumn("_found", F.lit(True))
    out = requests.join(p, requests[req_key] == p[key], "left")
    if req_key != key:
        out = out.drop(p[key])
    found = F.coalesce(F.col("_found"), F.lit(False))
    return (out.withColumn("found", found).drop("_found")
               .withColumn("error", F.when(~F.col("found"), S.error_record(
                   C.ERR_NOT_FOUND, C.MSG_NOT_FOUND, C.DETAILS_NOT_FOUND))))


def exists(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``left`` whose key exists in ``right`` (left semi join)."""
    return left.join(right, on, "left_semi")


def missing(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``left`` whose key is absent from ``right`` (left anti join)."""
    return left.join(right, on, "left_anti")


def latest_per_key(updates: DataFrame, key: str | list[str], seq: str) -> DataFrame:
    """The last write per key by ``seq`` (whole row; rows that tie in
    ``seq`` are told apart by a hash of the row, so the choice is stable).

    ``max_by`` is a partial aggregate: every map task keeps one row per key
    before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in updates.columns if c not in keys]
    order = F.struct(F.col(seq), F.xxhash64(*[F.col(c) for c in rest]))
    agg = updates.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("_last"))
    return agg.select(*keys, *[F.col("_last").getField(c).alias(c) for c in rest])


def upsert(base: DataFrame, updates: DataFrame, key: str | list[str], seq: str) -> DataFrame:
    """Whole-row replace, last write by ``seq`` wins; keys absent from
    base are added. ``updates`` must carry the base columns and ``seq``."""
    keys = [key] if isinstance(key, str) else list(key)
    latest = latest_per_key(updates, keys, seq).select(*base.columns)
    return base.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def net_new_count(base: DataFrame, updates: DataFrame, key: str | list[str]) -> DataFrame:
    """A2: number of distinct update keys that are not in base (count growth)."""
    keys = [key] if isinstance(key, str) else list(key)
    new_keys = updates.select(*keys).distinct().join(base.select(*keys), keys, "left_anti")
    return new_keys.agg(F.count(F.lit(1)).cast("bigint").alias("net_new"))


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Store a catalog version as ``<root>/version=<n>`` and return its path.
    Plain parquet has no row-level MERGE, so an upsert result read from
    version n is written as version n+1; an existing version is never
    overwritten (the write fails instead)."""
    path = f"{root.rstrip('/')}/version={int(version)}"
    df.write.mode("errorifexists").parquet(path)
    return path
