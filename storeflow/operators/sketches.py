"""Latency percentiles from mergeable sketches.

A request log is reduced once to one KLL sketch per group and day (a few KB
each, whatever the number of requests). Sketches of days, runs or other logs
are merged, and percentiles, counts, least and greatest values come from the
merged ones: a new day adds its sketch and rereads nothing. A percentile's
rank is off by at most ``rank_error`` of the requests (with the certainty that
the sketch's size gives); counts, least and greatest values are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .loadstats import pct_name

#: Size of a sketch, and the rank error that is allowed for (three times what the size promises).
SIZE = 800
RANK_ERROR = 0.01


def daily(log: DataFrame, by: list[str], value: str = "elapsed_ms", ts: str = "ts", size: int = SIZE) -> DataFrame:
    """One row per group and day: requests, failures, first and last time and
    the sketch of ``value``. Rows without a value count as requests only; a
    group without any value has no sketch."""
    x = F.col(value).cast("double")
    day = log.withColumn("day", F.col(ts).cast("date")).withColumn("_x", x)
    counts = day.groupBy(*by, "day").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 400).alias("failures"),
                                         F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    sketches = day.where("_x is not null and not isnan(_x)").groupBy(*by, "day").agg(F.kll_sketch_agg_double("_x", F.lit(size)).alias("sketch"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*by, "day")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return counts.alias("c").join(sketches.alias("s"), on, "left").select("c.*", "s.sketch")


def merged(sketches: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """The daily rows of each group put together."""
    return sketches.groupBy(*by).agg(
        F.sum("requests").alias("requests"), F.sum("failures").alias("failures"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.count("sketch").alias("_n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("_sketch")).withColumn(
        "sketch", F.when(F.col("_n") > 0, F.col("_sketch"))).drop("_n", "_sketch")


def quantile(p: float | list[float], sketch: str = "sketch") -> Column:
    at = F.array(*[F.lit(float(x)) for x in p]) if isinstance(p, list) else F.lit(float(p))
    return F.when(F.col(sketch).isNotNull(), F.kll_sketch_get_quantile_double(F.col(sketch), at))


def statistics(sketches: DataFrame, by: list[str], percentiles: list[float] = C.PERCENTILES) -> DataFrame:
    """A5-A7 from daily rows: requests, failures, valued (requests with a
    value), min_ms, max_ms, median_ms and the percentiles."""
    m = merged(sketches, by)
    n = F.when(F.col("sketch").isNotNull(), F.kll_sketch_get_n_double("sketch")).otherwise(0)
    return m.select(*by, "requests", "failures", n.alias("valued"), quantile(0.0).alias("min_ms"), quantile(1.0).alias("max_ms"),
                    quantile(0.5).alias("median_ms"), *[quantile(p).alias(pct_name(p)) for p in percentiles])


def compare(sketches: DataFrame, run: str, by: list[str], base: str, other: str) -> DataFrame:
    """J7 from daily rows that carry their run: both runs' counts, least and
    greatest values and medians side by side, and the ratios of counts and medians."""
    st = statistics(sketches, [run, *by], [])
    metrics = ["requests", "min_ms", "max_ms", "median_ms"]
    out = st.groupBy(*by).pivot(run, [base, other]).agg(*[F.first(m).alias(m) for m in metrics])
    ratio = lambda m: F.when(F.col(f"{base}_{m}") != 0, F.col(f"{other}_{m}") / F.col(f"{base}_{m}")).alias(f"{m}_ratio")
    return out.select("*", ratio("requests"), ratio("median_ms"))


def rank_gap(log: DataFrame, by: list[str], told: DataFrame, value: str, columns: dict[str, float]) -> DataFrame:
    """Per group, how far (as a share of its rows) each told percentile
    (column: the share below it) is from the ranks that its value has in the log."""
    both = log.select(*by, F.col(value).alias("_x")).where("_x is not null").join(told.select(*by, *columns), by)
    n = F.count(F.lit(1))
    gaps = []
    for c, p in columns.items():
        below, upto = F.count_if(F.col("_x") < F.col(c)) / n, F.count_if(F.col("_x") <= F.col(c)) / n
        gaps.append(F.greatest(F.lit(0.0), below - F.lit(p), F.lit(p) - upto).alias(c))
    return both.groupBy(*by).agg(*gaps)
