"""Driver tables (one parquet file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table lazily (a file or a folder of part files); Catalyst
    prunes columns and pushes filters into the parquet scan from whatever
    the caller selects."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(table_path(sf_dir, name))
