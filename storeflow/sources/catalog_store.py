"""A stored catalog that is changed in place, bucket by bucket.

A product's bucket is a hash of its id. Rows lie under ``data/bucket=b/write=n``
and a version is a small table of the write to read for each bucket. An upsert
reads, merges and writes only the buckets that its updates touch (a dynamic
partition overwrite of ``write=n+1``, so a try that failed half-way is simply
written over), then publishes version n+1. Files of other buckets keep their
names, older versions stay readable, and until the version table is there
readers see the version before. Files carry a Bloom filter of the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import latest_per_key

BUCKETS = 64
VERSION = "bucket int, write int"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class CatalogStore:
    def __init__(self, spark: SparkSession, root: str, key: str, schema, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("bigint")), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Published versions, ascending."""
        fs, p = _fs(self.spark, f"{self.root}/versions")
        if not fs.exists(p):
            return []
        done = [s.getPath() for s in fs.listStatus(p) if fs.exists(_fs(self.spark, f"{s.getPath()}/_SUCCESS")[1])]
        return sorted(int(x.getName().split("=")[1]) for x in done)

    def _writes(self, version: int) -> dict[int, int]:
        """The write of each bucket (at most as many as there are buckets)."""
        rows = self.spark.read.schema(VERSION).parquet(f"{self.root}/versions/version={version}").collect()
        return {r.bucket: r.write for r in rows}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """All rows of a version (by default the last), or of some buckets."""
        version = self.versions()[-1] if version is None else version
        paths = [f"{self.root}/data/bucket={b}/write={w}" for b, w in sorted(self._writes(version).items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def get(self, *ids: int) -> DataFrame:
        """J1 for a few ids: only their buckets are read, and of these only row
        groups whose range and Bloom filter admit an id."""
        if not ids:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.createDataFrame([(int(x),) for x in ids], f"{self.key} bigint")
        return self.read(only=self._touched(rows)).where(F.col(self.key).isin(*[int(x) for x in ids]))

    def lookup(self, requests: DataFrame, request_key: str) -> DataFrame:
        """J1 J3 for a table of requests: each with its row (``found`` tells
        whether there is one). Only requested buckets are read."""
        keyed = requests.withColumnRenamed(request_key, self.key) if request_key != self.key else requests
        rows = self.read(only=self._touched(keyed.where(F.col(self.key).isNotNull())))
        told = rows.withColumn("found", F.lit(True)).withColumnRenamed(self.key, "_key")
        joined = keyed.join(told, F.col(self.key) == F.col("_key"), "left").drop("_key").withColumn("found", F.coalesce("found", F.lit(False)))
        return joined.withColumnRenamed(self.key, request_key) if request_key != self.key else joined

    def _store(self, rows: DataFrame, version: int) -> None:
        """Write rows as write ``version`` of their buckets, sorted by key, so
        that row groups have narrow ranges of ids."""
        cols = [f.name for f in self.schema.fields]
        (rows.select(*cols, self.bucket().alias("bucket"), F.lit(version).alias("write"))
             .repartition("bucket").sortWithinPartitions("bucket", self.key)
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{self.key}", "true")
             .option(f"parquet.enable.dictionary#{self.key}", "false")  # ids are unique
             .partitionBy("bucket", "write").parquet(f"{self.root}/data"))

    def _publish(self, writes: dict[int, int], version: int) -> int:
        fs, p = _fs(self.spark, f"{self.root}/versions/version={version}")
        if fs.exists(p) and not fs.exists(_fs(self.spark, f"{self.root}/versions/version={version}/_SUCCESS")[1]):
            fs.delete(p, True)  # left by a try that failed
        table = self.spark.createDataFrame(sorted(writes.items()), VERSION) if writes else self.spark.createDataFrame([], VERSION)
        table.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/versions/version={version}")
        return version

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}

    def create(self, rows: DataFrame) -> int:
        """The first version: all rows."""
        if self.versions():
            raise ValueError("the catalog exists")
        self._store(rows, 1)
        return self._publish({b: 1 for b in self._touched(rows)}, 1)

    def upsert(self, updates: DataFrame, seq: str) -> int:
        """The last write of each key by ``seq`` replaces its row or adds
        one; returns the new version. Only touched buckets are read and written."""
        now = self.versions()[-1]
        latest = latest_per_key(updates, self.key, seq).select(*[f.name for f in self.schema.fields])
        touched = self._touched(updates)
        base = self.read(now, touched)
        merged = base.join(latest.select(self.key), self.key, "left_anti").unionByName(latest)
        self._store(merged, now + 1)
        return self._publish(self._writes(now) | {b: now + 1 for b in touched}, now + 1)
