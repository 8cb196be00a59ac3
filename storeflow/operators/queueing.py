"""Queue analytics: FIFO replay, backlog depth, samples, peaks, build-up
rate, capacity table, arrivals per window (W3-W6, A8-A11, S14).

Ordered recurrences (positions, FIFO finish times, running depth) never
put a queue into one window partition. Rows are sorted with a
range-partitioned sort (Spark samples the keys, so a queue holding a third
of all rows is cut into many balanced blocks) and numbered inside their
block; the numbered blocks are written once to the shared checkpoint
folder, so every consumer sees the same numbering. Per-block aggregates
form a small table whose prefix over blocks gives each block's offset;
ordered windows then run inside (block, queue) only.
Times are BIGINT microseconds throughout (exact arithmetic).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..session import materialize
from .ordering import prefix_before, previous_value, rank_within, running_sum

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def fifo_finish(arrivals: DataFrame, queue: str, t_us: str, tie: str, service_us: int,
                servers: int = C.PAYMENT_SLOTS) -> DataFrame:
    """Finish time of every arrival in a FIFO queue with ``servers``
    identical servers and fixed service time.

    Arrival i (0-based, by (t, tie)) goes to lane i % c as its k-th job,
    k = i div c, and finishes at (k+1)*S + max_{j<=k in lane}(a_j - j*S).
    Adds seq, lane, finish_us, response_us (finish - arrival) and
    wait_us (response - service)."""
    S_ = F.lit(service_us).cast("bigint")
    c = F.lit(servers).cast("bigint")
    d = rank_within(arrivals, [queue], [t_us, tie], "seq")
    d = (d.withColumn("lane", F.col("seq") % c)
          .withColumn("k", F.floor(F.col("seq") / c).cast("bigint"))
          .withColumn("_v", F.col(t_us).cast("bigint") - F.col("k") * S_))
    key = [queue, "lane"]
    mb = d.groupBy("_blk", *key).agg(F.max("_v").alias("_mb"))
    prefix = prefix_before(mb, key, "_mb", "max", "_pre").select("_blk", *key, "_pre")
    wl = (Window.partitionBy("_blk", *key).orderBy("k")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.join(prefix, ["_blk", *key]).withColumn("_run", F.max("_v").over(wl))
    best = F.greatest(F.col("_run"), F.coalesce(F.col("_pre"), F.col("_run")))
    finish = (F.col("k") + 1) * S_ + best
    return (d.withColumn("finish_us", finish)
             .withColumn("response_us", F.col("finish_us") - F.col(t_us))
             .withColumn("wait_us", F.col("response_us") - S_)
             .drop("_blk", "_v", "_pre", "_run", "k"))


def depth_changes(visits: DataFrame, queue: str, id_col: str, arrive_us: str, leave_us: str) -> DataFrame:
    """+1 at every arrival, -1 at every completion (none while ``leave_us`` is
    null), in one pass. ``id`` tells changes at equal times apart."""
    both = F.array(F.struct(F.col(arrive_us).alias("ts_us"), F.lit(1).alias("delta")),
                   F.struct(F.col(leave_us).alias("ts_us"), F.lit(-1).alias("delta")))
    return (visits.select(queue, F.col(id_col).alias("id"), F.inline(both)).where(F.col("ts_us").isNotNull()))


def backlog_depth(changes: DataFrame, queue: str) -> DataFrame:
    """Queue depth after every arrival (+1) and completion (-1); at
    equal times completions are applied first, then by id."""
    return running_sum(changes, [queue], ["ts_us", "delta", "id"], "delta", "depth").select(
        queue, "id", "ts_us", "delta", "depth")


def sample_depth(changes: DataFrame, queue: str, every_us: int = HOUR_US) -> DataFrame:
    """S14 analogue: depth at the end of each sampling period = running sum
    of the per-period net change (deterministic; no per-event window)."""
    per = (changes.withColumn("sample_us", F.floor(F.col("ts_us") / every_us).cast("bigint") * every_us)
                  .groupBy(queue, "sample_us").agg(F.sum("delta").cast("bigint").alias("net")))
    return running_sum(per, [queue], ["sample_us"], "net", "depth").select(queue, "sample_us", "depth")


def sample_deltas(samples: DataFrame, run: str, t: str, value: str) -> DataFrame:
    """Sample-to-sample change of a sample series (blocked ``lag``, so a
    long series is not one window partition)."""
    prev = previous_value(samples, [run], [t], value, "_prev")
    return prev.withColumn("delta", F.col(value) - F.col("_prev")).drop("_prev")


def exact_slope(y, x_us, per: float = 1e6):
    """Least-squares slope of integer ``y`` on integer microsecond offsets
    ``x_us`` (offsets from the first sample, so no cancellation), per
    second. The moments are exact DECIMAL(38,0) sums and the only rounding
    is the final division, so every engine gets the same double."""
    d = "decimal(38,0)"
    x, yy = x_us.cast(d), y.cast(d)
    n = F.count(F.lit(1)).cast(d)
    sx, sy = F.sum(x), F.sum(yy)
    sxy, sxx = F.sum(x * yy), F.sum(x * x)
    num = (n * sxy - sx * sy).cast("double")
    den = (n * sxx - sx * sx).cast("double")
    return F.when(den != 0, num / den * F.lit(per))


def peak_and_rate(samples: DataFrame, run: str, t_us: str, value: str) -> DataFrame:
    """Peak value with its earliest time, then the build-up rate
    from the first sample to the peak: least-squares slope and end-point
    rate (per second). Two aggregations over the (small, materialized)
    sample series; the second keeps samples up to the peak; the slope is
    computed from exact integer moments (``exact_slope``)."""
    samples = materialize(samples.select(run, t_us, value))
    v, t = F.col(value), F.col(t_us)
    ends = samples.groupBy(run).agg(
        F.max(v).alias("peak_depth"),
        F.max_by(t, F.struct(v, -t)).alias("peak_us"),
        F.min(t).alias("first_us"),
        F.min_by(v, t).alias("first_depth"))
    slope = (samples.join(ends.select(run, "peak_us", "first_us"), run).where(t <= F.col("peak_us"))
                    .groupBy(run).agg(exact_slope(v, t - F.col("first_us")).alias("slope_per_s")))
    dt = (F.col("peak_us") - F.col("first_us")) / F.lit(1e6)
    return ends.join(slope, run).select(
        run, "peak_depth", "peak_us", "first_us", "first_depth", "slope_per_s",
        F.when(dt > 0, (F.col("peak_depth") - F.col("first_depth")) / dt).alias("endpoint_rate_per_s"))


def capacity_table(demand: DataFrame, queue: str, service_s: float,
                   workers: list[int] = C.SCENARIO_WORKERS,
                   rounded_rate: float | None = None) -> DataFrame:
    """A10: per queue and worker count: capacity, gap, share of demand met,
    backlog over the observed span, its clearance time and the workers
    needed. ``demand`` has queue, arrivals, span_s (from the data).

    ``rounded_rate`` reproduces the report's 0.33/s per worker; by default
    the exact 1/service_s is used."""
    d = demand.withColumn("demand_per_s", F.col("arrivals") / F.col("span_s"))
    d = d.withColumn("workers", F.explode(F.array(*[F.lit(w) for w in workers])))
    return capacity_rows(d, service_s, rounded_rate, keep=[queue, "workers", "arrivals", "span_s"])


def capacity_rows(scenarios: DataFrame, service_s: float, rounded_rate: float | None = None,
                  keep: list[str] | None = None) -> DataFrame:
    """A10 on scenario rows with workers, demand_per_s, arrivals, span_s."""
    per = F.lit(rounded_rate if rounded_rate is not None else 1.0 / service_s)
    cap = F.col("workers") * per
    backlog = F.greatest(F.col("arrivals") - cap * F.col("span_s"), F.lit(0.0))
    keep = keep or [c for c in scenarios.columns if c != "demand_per_s"]
    return scenarios.select(
        *keep, "demand_per_s",
        cap.alias("capacity_per_s"), (cap - F.col("demand_per_s")).alias("gap_per_s"),
        (cap / F.col("demand_per_s") * 100).alias("pct_met"),
        backlog.alias("backlog"), (backlog / cap).alias("clearance_s"),
        F.ceil(F.col("demand_per_s") / per).cast("bigint").alias("workers_needed"))


def arrivals_per_window(df: DataFrame, by: list[str], ts: str, width: str = "1 hour") -> DataFrame:
    """Tumbling-window arrival counts (same code in batch and streaming)."""
    start = S.epoch_us(df.schema[ts].dataType, F.col("w.start"))
    return (df.groupBy(*by, F.window(F.col(ts), width).alias("w"))
              .agg(F.count(F.lit(1)).cast("bigint").alias("arrivals"))
              .select(*by, start.alias("window_start_us"), "arrivals"))
