"""Request statistics and queue analytics over ``events``.

``events`` is read as a request log (name = event_type, elapsed_ms =
value, failures = error events) and as the arrival stream of one queue
per event type, served FIFO with a fixed service time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..operators import loadstats as LS
from ..operators import queueing as Q
from ..operators import sketches as SK
from ..session import materialize, scratch_path
from ..sources import samples as SM
from ..sources import tables
from .registry import register

SERVICE_S = 1500
SERVICE_US = SERVICE_S * 1_000_000
SERVERS = [1, 2]


def _request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.load(spark, sf_dir, "events")
    return ev.select(F.lit("GET").alias("method"), F.col("event_type").alias("name"),
                     F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
                     F.col("value").alias("elapsed_ms"), "ts")


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.load(spark, sf_dir, "events")
    return ev.select("event_type", "event_id", S.epoch_us(ev, "ts").alias("t_us"))


def _fifo(spark: SparkSession, sf_dir: str, servers: int) -> DataFrame:
    return Q.fifo_finish(_arrivals(spark, sf_dir), "event_type", "t_us", "event_id",
                         SERVICE_US, servers)


PCT_SQL = ", ".join(f"round(q[{i + 1}], 9) as {LS.pct_name(p)}" for i, p in enumerate(C.PERCENTILES))
# Averages and interpolated percentiles are rounded to 9 decimals in both
# engines: summation order differs between them in the last bits.
DIGITS = 9


def _rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.round(c, DIGITS).alias(c) if c in cols else F.col(c) for c in df.columns])
PCT_LIST = "[" + ", ".join(str(p) for p in C.PERCENTILES) + "]"


@register("request_stats", f"""
with s as (
  select event_type as name, cast(count(*) as bigint) as requests,
         cast(count(*) filter (where event_type = 'error') as bigint) as failures,
         avg(value) as avg_ms, min(value) as min_ms, max(value) as max_ms,
         median(value) as median_ms, quantile_cont(value, {PCT_LIST}) as q,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as span_s
  from events group by event_type)
select name, requests, failures, round(avg_ms, 9) as avg_ms, min_ms, max_ms,
       round(median_ms, 9) as median_ms, {PCT_SQL},
       case when span_s > 0 then requests / span_s end as rps,
       (requests - failures) / requests as success_rate
from s
""")
def request_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request name: counts, latency summary, percentiles, rps."""
    st = LS.request_stats(_request_log(spark, sf_dir), ["name"])
    return _rounded(st, ["avg_ms", "median_ms"] + [LS.pct_name(p) for p in C.PERCENTILES])


@register("run_compare", """
with m as (select (epoch_us(min(ts)) + epoch_us(max(ts))) / 2 as mid from events),
r as (select case when epoch_us(ts) < (select mid from m) then 'first' else 'second' end as run,
             event_type as name, value from events),
s as (select run, name, cast(count(*) as bigint) as requests, avg(value) as avg_ms from r group by run, name)
select a.name, a.requests as first_requests, round(a.avg_ms, 9) as first_avg_ms,
       b.requests as second_requests, round(b.avg_ms, 9) as second_avg_ms,
       b.requests / a.requests as requests_ratio, round(b.avg_ms / a.avg_ms, 9) as avg_ms_ratio
from s a join s b on a.name = b.name and a.run = 'first' and b.run = 'second'
""")
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two halves of the observed period as two runs, compared per name."""
    log = _request_log(spark, sf_dir)
    log = log.withColumn("t", S.epoch_us(log, "ts"))
    # the midpoint is one scalar (a bounded one-row aggregate)
    mid = log.agg(((F.min("t") + F.max("t")) / 2).alias("mid")).first()["mid"]
    runs = log.withColumn("run", F.when(F.col("t") < F.lit(mid), "first").otherwise("second"))
    stats = runs.groupBy("run", "name").agg(F.count(F.lit(1)).cast("bigint").alias("requests"),
                                            F.avg("elapsed_ms").alias("avg_ms"))
    cmp = LS.compare_runs(stats, "run", ["name"], ["requests", "avg_ms"], "first", "second")
    out = cmp.select("name", "first_requests", "first_avg_ms", "second_requests", "second_avg_ms",
                     "requests_ratio", "avg_ms_ratio")
    return _rounded(out, ["first_avg_ms", "second_avg_ms", "avg_ms_ratio"])


def _fifo_sql(servers: list[int]) -> str:
    parts = " union all ".join(
        f"select {c} as servers, *, seq % {c} as lane, seq // {c} as k from a" for c in servers)
    return f"""
a as (select event_type, event_id, epoch_us(ts) as t_us,
             row_number() over (partition by event_type order by epoch_us(ts), event_id) - 1 as seq
      from events),
u as ({parts}),
f as (select servers, event_type, event_id, t_us, cast(seq as bigint) as seq, cast(lane as bigint) as lane,
             (k + 1) * {SERVICE_US} + max(t_us - k * {SERVICE_US}) over (
               partition by servers, event_type, lane order by k
               rows between unbounded preceding and current row) as finish_us
      from u)"""


@register("fifo_finish", f"""
with {_fifo_sql(SERVERS)}
select servers, event_type, event_id, seq, lane, finish_us, finish_us - t_us as response_us,
       finish_us - t_us - {SERVICE_US} as wait_us
from f
""")
def fifo_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIFO finish, response and wait time per arrival, 1 and 2 servers."""
    out = None
    for c in SERVERS:
        f = _fifo(spark, sf_dir, c).select(
            F.lit(c).alias("servers"), "event_type", "event_id", "seq", "lane", "finish_us",
            "response_us", "wait_us")
        out = f if out is None else out.unionByName(f)
    return out


# An order waits in its priority's queue from its order date until the last
# of its lines is shipped (never before it was placed); an order without
# lines has not left yet.
VISITS_SQL = """
v as (select o_orderpriority as queue, o_orderkey as id, epoch_us(o_orderdate) as arrive_us,
             case when s is not null then greatest(epoch_us(o_orderdate), epoch_us(s)) end as leave_us
      from orders left join (select l_orderkey, max(l_shipdate) as s from lineitem group by 1) on l_orderkey = o_orderkey)"""

DEPTH_SQL = f"""
{VISITS_SQL},
ev as (select queue, id, arrive_us as ts_us, 1 as delta from v
       union all select queue, id, leave_us, -1 from v where leave_us is not null),
d as (select queue, id, ts_us, delta,
             sum(delta) over (partition by queue order by ts_us, delta, id
                              rows between unbounded preceding and current row) as depth
      from ev),
smp as (select queue, sample_us,
               sum(s) over (partition by queue order by sample_us
                            rows between unbounded preceding and current row) as depth
        from (select queue, (ts_us // {Q.DAY_US}) * {Q.DAY_US} as sample_us, sum(delta) as s
              from ev group by 1, 2))"""


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.load(spark, sf_dir, "lineitem")
    shipped = li.groupBy("l_orderkey").agg(F.max(S.epoch_us(li, "l_shipdate")).alias("shipped_us"))
    o = tables.load(spark, sf_dir, "orders")
    arrive = S.epoch_us(o, "o_orderdate")
    visits = o.select(F.col("o_orderpriority").alias("queue"), F.col("o_orderkey").alias("id"), arrive.alias("arrive_us"))
    return (visits.join(shipped, visits["id"] == shipped["l_orderkey"], "left")
                  .select("queue", "id", "arrive_us",
                          F.when(F.col("shipped_us").isNotNull(), F.greatest("arrive_us", "shipped_us")).alias("leave_us")))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.depth_changes(_visits(spark, sf_dir), "queue", "id", "arrive_us", "leave_us")


@register("backlog_depth", f"""
with {DEPTH_SQL}
select queue, id, ts_us, cast(delta as integer) as delta, cast(depth as bigint) as depth from d
""")
def backlog_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders per priority after every order and completion."""
    d = Q.backlog_depth(_changes(spark, sf_dir), "queue")
    return d.select("queue", "id", "ts_us", F.col("delta").cast("int"), F.col("depth").cast("bigint"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.sample_depth(_changes(spark, sf_dir), "queue", Q.DAY_US)


@register("queue_samples", f"""
with {DEPTH_SQL}
select queue, sample_us, cast(depth as bigint) as depth,
       cast(depth - lag(depth) over (partition by queue order by sample_us) as bigint) as delta
from smp
""")
def queue_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily queue-depth samples and sample-to-sample change."""
    s = Q.sample_deltas(_samples(spark, sf_dir), "queue", "sample_us", "depth")
    return s.select("queue", "sample_us", F.col("depth").cast("bigint"), F.col("delta").cast("bigint"))


@register("queue_peak_rate", f"""
with {DEPTH_SQL},
pk as (select queue, max(depth) as peak from smp group by 1),
pt as (select s.queue, min(sample_us) as peak_us from smp s join pk using (queue)
       where s.depth = pk.peak group by 1),
fs as (select queue, arg_min(sample_us, sample_us) as first_us, arg_min(depth, sample_us) as first_depth
       from smp group by 1),
sl0 as (select s.queue, cast(count(*) as decimal(38,0)) as n,
               sum(cast(s.sample_us - fs.first_us as decimal(38,0))) as sx,
               sum(cast(s.depth as decimal(38,0))) as sy,
               sum(cast(s.sample_us - fs.first_us as decimal(38,0)) * cast(s.depth as decimal(38,0))) as sxy,
               sum(cast(s.sample_us - fs.first_us as decimal(38,0)) * cast(s.sample_us - fs.first_us as decimal(38,0))) as sxx
        from smp s join pt using (queue) join fs using (queue)
        where s.sample_us <= pt.peak_us group by 1),
sl as (select queue,
              case when cast(n * sxx - sx * sx as double) <> 0
                   then cast(n * sxy - sx * sy as double) / cast(n * sxx - sx * sx as double) * 1000000.0
              end as slope_per_s
       from sl0)
select pk.queue, cast(pk.peak as bigint) as peak_depth, pt.peak_us, fs.first_us,
       cast(fs.first_depth as bigint) as first_depth, sl.slope_per_s,
       case when pt.peak_us > fs.first_us
            then (pk.peak - fs.first_depth) / ((pt.peak_us - fs.first_us) / 1e6) end as endpoint_rate_per_s
from pk join pt using (queue) join fs using (queue) join sl using (queue)
""")
def queue_peak_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak depth and time, build-up slope and end-point rate."""
    s = _samples(spark, sf_dir)
    r = Q.peak_and_rate(s, "queue", "sample_us", "depth")
    return r.select("queue", F.col("peak_depth").cast("bigint"), "peak_us", "first_us",
                    F.col("first_depth").cast("bigint"), "slope_per_s", "endpoint_rate_per_s")


WORKERS_SQL = ", ".join(f"({w})" for w in C.SCENARIO_WORKERS)


@register("capacity_table", f"""
with dm as (select event_type, cast(count(*) as bigint) as arrivals,
                   (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as span_s from events group by 1),
x as (select dm.*, arrivals / span_s as demand_per_s, w.workers,
             w.workers * (1.0 / {SERVICE_S}) as cap
      from dm, (select * from (values {WORKERS_SQL}) as t(workers)) w)
select event_type, workers, arrivals, span_s, demand_per_s, cap as capacity_per_s,
       cap - demand_per_s as gap_per_s, cap / demand_per_s * 100 as pct_met,
       greatest(arrivals - cap * span_s, 0.0) as backlog,
       greatest(arrivals - cap * span_s, 0.0) / cap as clearance_s,
       cast(ceil(demand_per_s / (1.0 / {SERVICE_S})) as bigint) as workers_needed
from x
""")
def capacity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: capacity scenarios per queue against the observed demand."""
    a = _arrivals(spark, sf_dir)
    demand = a.groupBy("event_type").agg(
        F.count(F.lit(1)).cast("bigint").alias("arrivals"),
        ((F.max("t_us") - F.min("t_us")) / F.lit(1e6)).alias("span_s"))
    return Q.capacity_table(demand, "event_type", SERVICE_S)


@register("arrivals_tumbling", f"""
select event_type, (epoch_us(ts) // {Q.HOUR_US}) * {Q.HOUR_US} as window_start_us,
       cast(count(*) as bigint) as arrivals
from events group by 1, 2
""")
def arrivals_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals per event type and 1-hour tumbling window."""
    ev = tables.load(spark, sf_dir, "events").select("event_type", "ts")
    return Q.arrivals_per_window(ev, ["event_type"], "ts", "1 hour")


#: Orders that take longer than this from order to last shipment are slow.
SLOW_ORDER_MS = 720 * 86_400_000.0


@register("slow_requests", f"""
with {VISITS_SQL}
select queue, id, (leave_us - arrive_us) / 1000.0 as elapsed_ms, 503 as status_code,
       '{C.ERR_SERVICE_UNAVAILABLE}' as error_code
from v where (leave_us - arrive_us) / 1000.0 > {SLOW_ORDER_MS}
""")
def slow_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose measured elapsed time exceeds the guard's limit."""
    start, end = F.timestamp_micros("arrive_us"), F.timestamp_micros("leave_us")
    timed = _visits(spark, sf_dir).withColumn("elapsed_ms", S.elapsed_ms(start, end))
    s = LS.slow_requests(timed, SLOW_ORDER_MS)
    return s.select("queue", "id", "elapsed_ms", "status_code", F.col("error.error").alias("error_code"))


def _within(df: DataFrame, by: list[str], log: DataFrame, told: DataFrame, columns: dict[str, float]) -> DataFrame:
    """``df`` with whether all told percentiles keep the rank error."""
    gaps = SK.rank_gap(log, by, told, "elapsed_ms", columns)
    ok = F.greatest(F.lit(0.0), *[F.col(c) for c in columns]) <= SK.RANK_ERROR
    return df.join(gaps.select(*by, ok.alias("within_bound")), by, "left")


@register("latency_sketches", """
select event_type as name, cast(count(*) as bigint) as requests, cast(count(*) filter (where event_type = 'error') as bigint) as failures,
       cast(count(value) as bigint) as valued, min(value) as min_ms, max(value) as max_ms, case when count(value) > 0 then true end as within_bound
from events group by event_type
""")
def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 A6 from one sketch per name and day, merged; that every percentile
    keeps the promised rank error is checked against the log."""
    log = _request_log(spark, sf_dir)
    st = materialize(SK.statistics(materialize(SK.daily(log, ["name"]), "day-sketches"), ["name"]), "sketch-statistics")
    columns = {LS.pct_name(p): p for p in C.PERCENTILES} | {"median_ms": 0.5}
    out = _within(st, ["name"], log, st, columns)
    return out.select("name", "requests", "failures", "valued", "min_ms", "max_ms", "within_bound")


@register("run_compare_sketches", """
with m as (select (epoch_us(min(ts)) + epoch_us(max(ts))) / 2 as mid from events),
r as (select case when epoch_us(ts) < (select mid from m) then 'first' else 'second' end as run, event_type as name, value from events),
s as (select run, name, cast(count(*) as bigint) as requests, min(value) as low, max(value) as high from r group by run, name)
select a.name, a.requests as first_requests, a.low as first_min_ms, a.high as first_max_ms,
       b.requests as second_requests, b.low as second_min_ms, b.high as second_max_ms, b.requests / a.requests as requests_ratio,
       true as first_within, true as second_within
from s a join s b on a.name = b.name and a.run = 'first' and b.run = 'second'
""")
def run_compare_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 from merged daily sketches: two runs side by side without rereading
    the log (which is read again only to check both medians' rank error)."""
    log = _request_log(spark, sf_dir)
    log = log.withColumn("t", S.epoch_us(log, "ts"))
    mid = log.agg(((F.min("t") + F.max("t")) / 2).alias("mid")).first()["mid"]  # one scalar
    runs = log.withColumn("run", F.when(F.col("t") < F.lit(mid), "first").otherwise("second"))
    cmp = materialize(SK.compare(materialize(SK.daily(runs, ["run", "name"]), "day-sketches"), "run", ["name"], "first", "second"), "run-comparison")
    out = cmp.select("name", "first_requests", "first_min_ms", "first_max_ms", "second_requests", "second_min_ms", "second_max_ms", "requests_ratio")
    for run in ("first", "second"):
        told = cmp.select("name", F.col(f"{run}_median_ms").alias("median_ms"))
        out = _within(out, ["name"], runs.where(F.col("run") == run), told, {"median_ms": 0.5}).withColumnRenamed("within_bound", f"{run}_within")
    return out


# A sample as a line of CSV, some of them damaged, in SQL that Spark and DuckDB read alike.
SAMPLE_LINE = ("queue || ',' || {ts} || ',' || case when depth % 7 = 5 then 'n/a' else cast(depth as varchar) end"
               " || case when depth % 7 = 3 then '' else ',' || cast(depth % 10 as varchar) end || case when depth % 7 = 6 then ',9' else '' end")
DUCK_TS = "strftime(make_timestamp(sample_us), '%Y-%m-%dT%H:%M:%SZ')"


@register("queue_samples_csv", f"""
with {DEPTH_SQL},
x as (select queue, sample_us, depth, {SAMPLE_LINE.format(ts=DUCK_TS)} as line, depth % 7 in (3, 5, 6) as bad from smp)
select case when bad then line end as line, case when not bad then queue end as run, case when not bad then sample_us end as t_us,
       case when not bad then cast(depth + depth % 10 as bigint) end as total
from x
""")
def queue_samples_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth samples written as CSV, some lines damaged, and read back:
    the readable ones with their total, the damaged ones as they stand."""
    path = scratch_path(spark, "samples-csv")
    ts = "date_format(to_utc_timestamp(timestamp_micros(sample_us), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    _samples(spark, sf_dir).select(F.expr(SAMPLE_LINE.format(ts=ts).replace("varchar", "string")).alias("line")).write.text(path)
    good, damaged = SM.split_queue_samples(SM.sample_lines(spark, path, header=False))
    return good.select(F.lit(None).cast("string").alias("line"), "run", "t_us", "total").unionByName(
        damaged.select("line", F.lit(None).cast("string").alias("run"), F.lit(None).cast("bigint").alias("t_us"), F.lit(None).cast("bigint").alias("total")))
