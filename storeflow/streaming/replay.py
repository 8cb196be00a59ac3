"""Tables as streams of files in a set order.

A file source takes files by their modification time, so a table is replayed
by writing its rows as files of a ``place`` and setting those times in the
order of places. A large place has several files, written by as many tasks;
empty files fill the others up, so as many files a trigger make every place one
micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .orders_stream import _fs

#: Modification time of the first file; the others follow a second apart.
FIRST_MS = 1_700_000_000_000


def by_time(df: DataFrame, us: str, files: int) -> Column:
    """The place of a row when the time span of ``us`` (microseconds) is cut
    into equal parts, so a later place never holds an earlier time."""
    r = df.agg(F.min(us).alias("low"), F.max(us).alias("high")).first()  # two scalars
    if r.low is None:
        return F.lit(0)
    width = (r.high - r.low) // files + 1
    return F.floor((F.col(us) - F.lit(r.low)) / F.lit(width)).cast("int")


def write_places(df: DataFrame, place: Column, path: str, end_of_input: DataFrame | None = None) -> str:
    """Write ``df`` as files by place, and ``end_of_input`` (rows that
    carry the watermark past all open state) as the last; returns the path."""
    spark = df.sparkSession
    # no task takes more than the advisory size of a place
    df.withColumn("place", place).hint("rebalance", F.col("place")).write.partitionBy("place").parquet(path)
    if end_of_input is not None:
        end_of_input.coalesce(1).withColumn("place", F.lit(1 << 20)).write.mode("append").partitionBy("place").parquet(path)
    fs, places = _places(spark, path)
    most = max((len(files) for _, files in places), default=1)
    if any(len(files) < most for _, files in places[:-1]):
        blank = f"{path.rstrip('/')}-blank"
        spark.createDataFrame([], df.schema).coalesce(1).write.parquet(blank)
        _, root = _fs(spark, blank)
        blank, util = _files(fs, root)[0], spark._jvm.org.apache.hadoop.fs.FileUtil
        for folder, files in places[:-1]:
            for k in range(len(files), most):
                to = spark._jvm.org.apache.hadoop.fs.Path(folder, f"none-{k}.parquet")
                util.copy(fs, blank, fs, to, False, spark._jsc.hadoopConfiguration())
                files.append(to)
    for k, (_, files) in enumerate(places):
        for file in files:
            fs.setTimes(file, FIRST_MS + 1000 * k, -1)
    return path


def _files(fs, folder) -> list:
    return [s.getPath() for s in fs.listStatus(folder) if s.isFile() and s.getPath().getName()[0] not in "._"]


def _places(spark, path: str):
    """The file system, and (folder, files) of every place in order."""
    fs, root = _fs(spark, path)
    folders = [s.getPath() for s in fs.listStatus(root) if "=" in s.getPath().getName()]
    return fs, [(f, _files(fs, f)) for f in sorted(folders, key=lambda f: int(f.getName().split("=")[1]))]


def stream(spark, path: str, schema, places: int = 1) -> DataFrame:
    """The written places as a stream, ``places`` of them a micro-batch."""
    most = max((len(files) for _, files in _places(spark, path)[1]), default=1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", places * most).parquet(path)
