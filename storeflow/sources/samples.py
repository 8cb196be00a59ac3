"""Queue-depth samples (run, ts, visible, not_visible) as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import QUEUE_SAMPLES

DAMAGED = "_damaged"


def write_queue_samples(samples: DataFrame, path: str) -> None:
    """Write run, ts, visible, not_visible as CSV files with a header."""
    samples.select("run", "ts", "visible", "not_visible").write.option("header", "true").csv(path)


def sample_lines(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Every line of the CSV files: its fields, or null fields and the whole
    line in ``_damaged`` where it has too few or too many fields, a number or
    a time that cannot be read, or no run or time. The schema is given, not
    inferred, so no extra pass is made."""
    df = (spark.read.schema(f"{QUEUE_SAMPLES}, {DAMAGED} string").option("header", str(header).lower()).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", DAMAGED).option("enforceSchema", "true").csv(path))
    fields = [c for c in df.columns if c != DAMAGED]
    incomplete = F.col("run").isNull() | F.col("ts").isNull() | F.col("visible").isNull() | F.col("not_visible").isNull()
    line = F.when(F.col(DAMAGED).isNotNull(), F.col(DAMAGED)).when(incomplete, F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]))
    return df.select(*[F.when(line.isNull(), F.col(c)).alias(c) for c in fields], line.alias(DAMAGED))


def split_queue_samples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples with their total and epoch microseconds, damaged lines)."""
    good = lines.where(F.col(DAMAGED).isNull()).drop(DAMAGED)
    good = good.withColumn("total", F.col("visible") + F.col("not_visible")).withColumn("t_us", F.unix_micros("ts"))
    return good, lines.where(F.col(DAMAGED).isNotNull()).select(F.col(DAMAGED).alias("line"))


def read_queue_samples(spark: SparkSession, path: str) -> DataFrame:
    """The readable samples of CSV files (header: run,ts,visible,not_visible)
    with total and epoch microseconds."""
    return split_queue_samples(sample_lines(spark, path))[0]
