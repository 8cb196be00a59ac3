"""Streaming queries: each drains a Structured Streaming pipeline over the
driver's ``events`` file (availableNow) and returns what its sinks hold,
which must equal the batch answer."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..operators import orders as O
from ..operators import queueing as Q
from ..session import rocksdb_state, scratch_path
from ..sources import tables
from ..streaming import lifecycle as LC
from ..streaming import orders_stream as ST
from ..streaming import replay as RP
from ..streaming import retry as RT
from .order_plans import MESSAGE_SQL
from .registry import register

COMPLETED_SCHEMA = ("order_id string, customer_id bigint, status string, n_items bigint, "
                    "created_at timestamp, message_id string, attempt int, batch int")
DEAD_SCHEMA = "message_id string, reason string, raw string, enqueued_at timestamp, batch int"
REJECTED_SCHEMA = "event_id bigint, event_type string, ts timestamp, status_code int, error string, order_id string, message_id string, batch int"
#: Bytes of the table and of a queue taken in one micro-batch (L4), so a batch's
#: fixed time stays small beside its work; messages a file.
TABLE_BYTES = QUEUE_BYTES = 128 << 20
MESSAGES = 20_000
#: Every so many events one order has this many items, beyond the message limit.
LARGE_EVERY, LARGE_ITEMS = 2500, 8000


def _instant(df: DataFrame, name: str):
    """The table's wall-clock (NTZ) time as a TIMESTAMP instant, read as
    UTC whatever the session zone (watermarks need TIMESTAMP)."""
    return F.timestamp_micros(S.epoch_us(df, name))


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = tables.load(spark, sf_dir, "events").schema
    return ST.table_stream(spark, tables.table_path(sf_dir, "events"), schema, max_bytes_per_trigger=TABLE_BYTES)


def order_requests(ev: DataFrame) -> DataFrame:
    """Order requests from events other than errors: a signup in ten sends a
    body of wrong types, one event in LARGE_EVERY an order too large for a
    message; orders carry no id (the service assigns one)."""
    item = F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
                    F.lit(1).cast("bigint").alias("quantity"), F.col("value").alias("price"))
    items = F.array_repeat(item, F.when(F.col("event_id") % LARGE_EVERY == 7, LARGE_ITEMS).otherwise(1))
    good = F.to_json(F.struct(F.col("user_id").alias("customer_id"), items.alias("items")))
    bad = F.to_json(F.struct(F.concat(F.lit("user "), F.col("user_id")).alias("customer_id")))
    body = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 10 == 3), bad).otherwise(good)
    return ev.where(F.col("event_type") != "error").select(
        "event_id", "event_type", _instant(ev, "ts").alias("ts"), body.alias("body"))


def judge_requests(reqs: DataFrame) -> DataFrame:
    return ST.judged(reqs, now=F.col("ts"), generated_id=F.concat(F.lit("ord-"), F.col("event_id").cast("string")),
                     message_id=F.concat(F.lit("msg-"), F.col("event_id").cast("string")))


REQUESTS_SQL = f"""
req as (select event_id, event_type, user_id,
               event_type = 'signup' and event_id % 10 = 3 as bad, event_id % {LARGE_EVERY} = 7 as large
        from events where event_type <> 'error')"""


def _order_pipeline(spark: SparkSession, sf_dir: str, consume: bool = True) -> str:
    """Drain producer and consumer over the events table into a new folder."""
    root = scratch_path(spark, "order-stream")
    ev = _events_stream(spark, sf_dir)

    def judge(batch: DataFrame) -> DataFrame:
        rows = judge_requests(order_requests(batch))
        # a retrying producer publishes click orders twice (at-least-once)
        twice = (F.col("event_type") == "click") & (F.col("status_code") == 202)
        rows = rows.withColumn("sent", F.explode(F.when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("sent")
        # another producer writes damaged payloads (stray brace) for error events
        raw = batch.where(F.col("event_type") == "error").select(
            "event_id", "event_type", _instant(batch, "ts").alias("ts"), F.lit(202).alias("status_code"),
            F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("order_id"),
            F.concat(F.lit("raw-"), F.col("event_id").cast("string")).alias("message_id"),
            F.create_map().cast("map<string,string>").alias("attributes"),
            F.concat(F.col("props"), F.lit("}")).alias("body"))
        return rows.unionByName(raw)

    queues = [os.path.join(root, "queue-orders"), os.path.join(root, "queue-audit")]
    ST.drain(ST.publish(ev, judge, queues, os.path.join(root, "rejected"), os.path.join(root, "ck-publish"),
                        records_per_file=MESSAGES))
    if consume:
        split = ST.split_queue(ST.queue_stream(spark, queues[0], max_bytes_per_trigger=QUEUE_BYTES), os.path.join(root, "out"), os.path.join(root, "ck-split"))
        ST.drain(split)
    return root


@register("stream_orders", f"""
with {REQUESTS_SQL}
select 'ord-' || cast(event_id as varchar) as order_id, user_id as customer_id,
       'completed' as status, cast(1 as bigint) as n_items
from req where not bad and not large
""")
def stream_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders accepted, published,
    fanned out, consumed once despite redelivery, completed."""
    root = _order_pipeline(spark, sf_dir)
    ST.drain(ST.complete_received(spark, os.path.join(root, "out"), os.path.join(root, "ck-complete")))
    df = spark.read.schema(COMPLETED_SCHEMA).parquet(os.path.join(root, "out", "completed"))
    return df.select("order_id", "customer_id", "status", "n_items")


@register("stream_dead_letter", """
select 'raw-' || cast(event_id as varchar) as message_id, 'decode' as reason
from events where event_type = 'error'
""")
def stream_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecodable queue messages kept aside with their raw text."""
    root = _order_pipeline(spark, sf_dir)
    df = spark.read.schema(DEAD_SCHEMA).parquet(os.path.join(root, "out", "dead_letter"))
    return df.select("message_id", "reason")


@register("stream_rejected", f"""
with {REQUESTS_SQL}
select event_id, cast(case when bad then 400 else 500 end as integer) as status_code,
       case when bad then '{C.ERR_INVALID_INPUT}' else '{C.ERR_PUBLISH_FAILED}' end as error
from req where bad or large
""")
def stream_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that were not published, with their answer."""
    root = _order_pipeline(spark, sf_dir, consume=False)
    df = spark.read.schema(REJECTED_SCHEMA).parquet(os.path.join(root, "rejected"))
    return df.select("event_id", "status_code", "error")


@register("stream_audit", f"""
with {REQUESTS_SQL}
select 'msg-' || cast(event_id as varchar) as message_id,
       cast(case when event_type = 'click' then 2 else 1 end as bigint) as deliveries
from req where not bad and not large
union all select 'raw-' || cast(event_id as varchar), cast(1 as bigint) from events where event_type = 'error'
""")
def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second subscriber of the topic received."""
    root = _order_pipeline(spark, sf_dir, consume=False)
    lines = spark.read.text(os.path.join(root, "queue-audit"))
    return (lines.select(F.from_json("value", ST.ENVELOPE).alias("m")).groupBy("m.message_id")
                 .agg(F.count(F.lit(1)).cast("bigint").alias("deliveries")))


@register("orders_accepted", f"""
with {REQUESTS_SQL}
select event_id, cast(case when bad then 400 when large then 500 else 202 end as integer) as status_code,
       case when bad then '{C.ERR_INVALID_INPUT}' when large then '{C.ERR_PUBLISH_FAILED}' end as error,
       case when not bad and not large then '{C.MSG_ORDER_ASYNC}' end as message,
       case when not bad and not large then 'ord-' || cast(event_id as varchar) end as order_id,
       case when not bad and not large then 'msg-' || cast(event_id as varchar) end as message_id
from req
""")
def orders_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 P10 (async) F9: the answer to every order request."""
    rows = judge_requests(order_requests(tables.load(spark, sf_dir, "events")))
    ok = F.col("status_code") == 202
    return rows.select("event_id", "status_code", "error", F.when(ok, F.lit(C.MSG_ORDER_ASYNC)).alias("message"),
                       F.when(ok, F.col("order_id")).alias("order_id"), F.when(ok, F.col("message_id")).alias("message_id"))


@register("stream_arrivals", f"""
select event_type, (epoch_us(ts) // {Q.HOUR_US}) * {Q.HOUR_US} as window_start_us,
       cast(count(*) as bigint) as arrivals
from events group by 1, 2
""")
def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 streaming: hourly arrivals in update mode. Without a watermark no
    event is late; state is one small row per event type and hour."""
    root = scratch_path(spark, "arrivals-stream")
    ev = _events_stream(spark, sf_dir)
    agg = Q.arrivals_per_window(ev.select("event_type", _instant(ev, "ts").alias("ts")), ["event_type"], "ts", "1 hour")
    ST.drain(ST.run_update_sink(agg, os.path.join(root, "out"), os.path.join(root, "ck")))
    return ST.latest_versions(spark, os.path.join(root, "out"), ["event_type", "window_start_us"])


#: Micro-batches of replayed tables.
PLACES = 4
DAY_S = 86_400
STATUS = "user_id bigint, event_type string, status string, last_seq long, last_ms long, expired boolean"


def _replayed(df: DataFrame, us: str, columns: str, root: str, places=None, end: DataFrame | None = None) -> DataFrame:
    """A table (with its time ``us``) as a stream of files, by default in time order."""
    place = RP.by_time(df, us, PLACES) if places is None else places
    return RP.stream(df.sparkSession, RP.write_places(df, place, root, end), f"{columns}, place int").drop("place")


@register("stream_status_latest", f"""
select user_id, event_type, arg_max(props, event_id) as status, max(event_id) as last_seq,
       epoch_ms(max(ts)) + {C.RETENTION_SECONDS * 1000} < (select epoch_ms(max(ts)) - 3600000 from events) as expired
from events group by user_id, event_type
""")
def stream_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 streaming: the current payload of every user and event type; one
    unseen for the queue's retention of event time has expired, and holds no
    state."""
    root = scratch_path(spark, "status-stream")
    ev = tables.load(spark, sf_dir, "events")
    ev = ev.select("user_id", "event_type", F.col("props").alias("status"), F.col("event_id").alias("seq"), _instant(ev, "ts").alias("ts"))
    ev = ev.withColumn("us", F.unix_micros("ts"))
    told = LC.latest_status(_replayed(ev, "us", "user_id bigint, event_type string, status string, seq bigint, ts timestamp, us bigint", os.path.join(root, "in")),
                            ["user_id", "event_type"])
    ST.drain(ST.run_append_sink(told, os.path.join(root, "out"), os.path.join(root, "ck")))
    return LC.newest(spark, os.path.join(root, "out"), STATUS, ["user_id", "event_type"]).drop("last_ms")


#: Keys of the rows that end a replay; they match nothing and are never told.
END_KEY = -(1 << 63)
#: Rows of the larger table in one micro-batch, about: state holds the bound's time and one batch.
PLACE_ROWS = 5_000_000
#: An order line shipped within this time of its order has completed it.
WITHIN_S = 365 * DAY_S


@register("stream_elapsed", f"""
select o_orderkey as order_key, l_linenumber as line_no, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000.0 as elapsed_ms
from orders left join lineitem on l_orderkey = o_orderkey
     and l_shipdate >= o_orderdate and l_shipdate <= o_orderdate + interval {WITHIN_S} seconds
""")
def stream_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 streaming: measured time from each order to the shipment of its
    lines, two streams joined within a bound; orders without such a line once."""
    root = scratch_path(spark, "elapsed-stream")
    o, li = tables.load(spark, sf_dir, "orders"), tables.load(spark, sf_dir, "lineitem")
    o = o.select(F.col("o_orderkey").alias("order_key"), _instant(o, "o_orderdate").alias("arrived_at")).withColumn("us", F.unix_micros("arrived_at"))
    li = li.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
                   _instant(li, "l_shipdate").alias("completed_at")).withColumn("us", F.unix_micros("completed_at"))
    ends = [df.agg(F.max("us").alias("us"), F.count(F.lit(1)).alias("n")).first() for df in (o, li)]  # two scalars each
    high = max(e.us or 0 for e in ends) + (WITHIN_S + 30 * DAY_S) * 1_000_000
    places = max(PLACES, -(-max(e.n for e in ends) // PLACE_ROWS))

    def stream(df: DataFrame, time: str, columns: str) -> DataFrame:
        # a null key would be filtered before the watermark sees its time
        key = END_KEY + (time == "completed_at")
        end = spark.range(1).select(F.lit(key).cast("bigint").alias("order_key"), *[F.lit(0).alias(c) for c in df.columns if c == "line_no"],
                                    F.timestamp_micros(F.lit(high)).alias(time), F.lit(high).alias("us"))
        return _replayed(df, "us", columns, os.path.join(root, time), RP.by_time(df, "us", places), end).drop("us")
    told = LC.elapsed(stream(o, "arrived_at", "order_key bigint, arrived_at timestamp, us bigint"),
                      stream(li, "completed_at", "order_key bigint, line_no int, completed_at timestamp, us bigint"), "order_key", WITHIN_S)
    ST.drain(ST.run_append_sink(told.select("order_key", "line_no", "elapsed_ms"), os.path.join(root, "out"), os.path.join(root, "ck")))
    return spark.read.schema("order_key bigint, line_no int, elapsed_ms double").parquet(os.path.join(root, "out")).drop("batch")


#: Windows of the final counts, blocks of events (each two swapped) and the time that the watermark lags.
WINDOW_MS, BLOCKS, LAG_MS = 6 * 3_600_000, 8, DAY_S * 1000


@register("stream_final_windows", f"""
with b as (select event_type, epoch_us(ts) // 1000 as ms, xor((event_id * {BLOCKS}) // (select max(event_id) + 1 from events), 1) as place from events),
p as (select place, max(ms) - {LAG_MS} as high from b group by place),
w as (select place, max(high) over (order by place rows between unbounded preceding and 1 preceding) as watermark from p),
r as (select event_type, (ms // {WINDOW_MS}) * {WINDOW_MS} as window_ms, coalesce((ms // {WINDOW_MS} + 1) * {WINDOW_MS} <= watermark, false) as late
      from b join w using (place))
select event_type, window_ms * 1000 as window_start_us, cast(count(*) filter (where not late) as bigint) as arrivals,
       cast(count(*) filter (where late) as bigint) as late_arrivals
from r group by event_type, window_ms
""")
def stream_final_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 streaming: events in mixed time order, several micro-batches; the
    count of each window once it is final, and what came too late for it."""
    root = scratch_path(spark, "windows-stream")
    ev = tables.load(spark, sf_dir, "events")
    ev = ev.select("event_id", "event_type", _instant(ev, "ts").alias("ts"))
    last = ev.agg(F.max("event_id").alias("id"), F.max(F.unix_micros("ts")).alias("us")).first()  # two scalars
    block = F.expr(f"event_id * {BLOCKS} div {(last.id or 0) + 1}")
    end = spark.range(1).select(F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("string").alias("event_type"),
                                F.timestamp_micros(F.lit((last.us or 0) + (LAG_MS + 2 * WINDOW_MS) * 1000)).alias("ts"))
    stream = _replayed(ev, "ts", "event_id bigint, event_type string, ts timestamp", os.path.join(root, "in"), block.bitwiseXOR(F.lit(1).cast("bigint")).cast("int"), end)
    told = LC.final_windows(stream.drop("event_id"), ["event_type"], WINDOW_MS, delay=f"{LAG_MS} milliseconds")
    with rocksdb_state(spark):
        query = ST.run_append_sink(told, os.path.join(root, "out"), os.path.join(root, "ck"))
    ST.drain(query)
    rows = spark.read.schema("event_type string, window_ms long, bucket int, arrivals long, late boolean").parquet(os.path.join(root, "out"))
    return rows.groupBy("event_type", (F.col("window_ms") * 1000).alias("window_start_us")).agg(
        F.sum(F.when(F.col("late"), 0).otherwise(F.col("arrivals"))).alias("arrivals"),
        F.sum(F.when(F.col("late"), F.col("arrivals")).otherwise(0)).alias("late_arrivals"))


#: Damage of a message (OP.MESSAGES) that a repair exists for, and the day from which it does.
REPAIRS = {1: 1, 6: 2, 3: 3}
BROKEN = (1, 2, 3, 4, 5, 6, 10)


def _repaired(day: int):
    """The body after the repairs known on a day."""
    def repair(letters: DataFrame):
        body = F.col("body")
        out = F.when(body.endswith("}}"), F.expr("substr(body, 1, length(body) - 1)"))
        if day >= REPAIRS[6]:
            out = out.when(body.endswith("} x"), F.expr("substr(body, 1, length(body) - 2)"))
        if day >= REPAIRS[3]:
            out = out.when(F.contains(body, F.lit("{'")), F.translate(body, "'", '"'))
        return out
    return repair


@register("stream_retry", f"""
select 'msg-' || cast(event_id as varchar) as message_id,
       case when event_id % 11 in ({', '.join(str(k) for k in BROKEN if k not in REPAIRS)}) then 'expired' else 'completed' end as outcome,
       cast(case event_id % 11 {' '.join(f'when {k} then {day}' for k, day in REPAIRS.items())}
            else case when event_id % 11 in ({', '.join(map(str, BROKEN))}) then {C.RETENTION_SECONDS // DAY_S} else 0 end end as integer) as attempts
from events
""")
def stream_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 streaming: a message from every event, whole or damaged; dead letters
    are tried again every day, repaired ones complete, the others expire."""
    root = scratch_path(spark, "retry-stream")
    queue, out = os.path.join(root, "queue"), os.path.join(root, "out")
    ev = tables.load(spark, sf_dir, "events")
    body = F.expr(MESSAGE_SQL.replace("varchar", "string"))
    sent = ev.select(F.concat(F.lit("msg-"), F.col("event_id").cast("string")).alias("message_id"), F.create_map().cast("map<string,string>").alias("attributes"), body.alias("body"))
    ST.write_once(ST.envelope_json(sent), os.path.join(queue, "retry=-1"), "text", maxRecordsPerFile=MESSAGES)
    ST.drain(ST.split_queue(ST.queue_stream(spark, queue, max_bytes_per_trigger=QUEUE_BYTES), out, os.path.join(root, "ck", "split")))
    start = spark.read.schema(DEAD_SCHEMA).parquet(os.path.join(out, "dead_letter")).agg(F.max(F.unix_micros("enqueued_at"))).first()[0] or 0
    for day in range(1, C.RETENTION_SECONDS // DAY_S + 2):
        RT.run_round(spark, out, queue, day - 1, F.timestamp_micros(F.lit(start + day * DAY_S * 1_000_000)), _repaired(day))
    ST.drain(ST.run_processor(ST.queue_stream(spark, queue, max_bytes_per_trigger=QUEUE_BYTES), out, os.path.join(root, "ck")))
    done = spark.read.schema(COMPLETED_SCHEMA).parquet(os.path.join(out, "completed"))
    return done.select("message_id", F.lit("completed").alias("outcome"), F.col("attempt").alias("attempts")).unionByName(
        RT.expired(spark, out).select("message_id", F.lit("expired").alias("outcome"), "attempts"))
