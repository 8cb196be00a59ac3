"""Reading the tables and cutting lineage with written stage tables."""

from __future__ import annotations

import gc
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remember_stage, scratch_path


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package also where only the driver was
    told its folder (a cluster has it installed or sent by --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, by a path only Spark's readers need to understand."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed_text(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text (null: empty) plus named columns; other columns go."""
    with_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


class Stage:
    """A DataFrame written once to the shared checkpoint folder and read
    back, so lost executors cost a re-read, not a recomputation."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.spark, self.path = spark, scratch_path(spark, name)
        remember_stage(self.path)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the written table once its readers are done."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished stages now.
    It works when the driver's objects are collected: Python's first, whose
    references are given up a moment later, then the JVM's."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark._jvm.System.gc()
    time.sleep(0.3)


def stage(df: DataFrame, name: str) -> DataFrame:
    return Stage(df, name).df
