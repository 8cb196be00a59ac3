"""Order pipeline on Structured Streaming.

  producer (T1):  request bodies --S6 lenient decode--> P6 default id
                  --P7 pending--> S8 JSON --F9 size check--> topic (S9);
                  requests that fail (400, 500, 503) go to their own sink
  topic -> queue: every subscriber folder gets the raw message (S11)
  consumer (T2):  queue files (S10, rate-limited) --S7 strict decode-->
                  F11 split: poison -> dead letter (T4); good -> received
                  received -> T3 de-dup by order_id within the retention
                  horizon (F10) -> P8 completed (T8)

Messages are JSON lines ``{"message_id", "attributes": {"order_id"},
"body"}``. A micro-batch is decoded once, kept, and written to all its sinks by
``foreachBatch``, one folder per batch id. A folder that was finished is never written again, so a retried
batch changes nothing a reader may have seen. De-duplication runs on the time
a message was enqueued, which only grows along the queue, so no message is
late, whatever times its order carries. ``trigger(availableNow=True)`` drains
what is available and stops (T7). State lives in the checkpoint folder, so a
lost executor only re-runs its tasks.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..operators import orders as O
from ..sources import codec

ENVELOPE = "message_id string, attributes map<string,string>, body string"
RETENTION = f"{C.RETENTION_SECONDS} seconds"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _limited(r, files: int | None, size: int | None):
    """L4: at most so many files, or bytes, of a file source a micro-batch (one file at least)."""
    if files:
        r = r.option("maxFilesPerTrigger", files)
    return r.option("maxBytesPerTrigger", size) if size else r


def table_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """S10 for parquet: stream a table stored as one file or as a folder of
    part files."""
    r = _limited(spark.readStream.schema(schema), max_files_per_trigger, max_bytes_per_trigger)
    fs, p = _fs(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return r.parquet(path)
    return r.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def queue_stream(spark: SparkSession, queue_dir: str, max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Message envelopes from a queue folder (rate-limited by files or
    bytes) with the time they were enqueued."""
    r = _limited(spark.readStream.format("text"), max_files_per_trigger, max_bytes_per_trigger)
    env = F.from_json(F.col("value"), ENVELOPE)
    return r.load(queue_dir).select(env.alias("m"), F.col("value").alias("raw"),
                                    F.col("_metadata.file_modification_time").alias("enqueued_at")).select("m.*", "raw", "enqueued_at")


def judged(requests: DataFrame, *, body: str = "body", now: Column | None = None, generated_id: Column | None = None,
           message_id: Column | None = None, topic: bool = True) -> DataFrame:
    """Every request with its outcome: status_code 202, or 400 (body not
    decodable), 503 (no topic configured), 500 (message over the topic's size
    limit, F9) with ``error``; the message (message_id, attributes, body) and
    order_id of decodable requests. Each body is decoded once."""
    rest = [F.col(c) for c in requests.columns if c != body]
    r = codec.decode_rows(requests, body, "order", strict=False).select(*rest, "ok", F.col("value").alias("o"))
    r = r.withColumn("order_id", F.when(F.col("ok"), O.default_order_id(F.col("o.order_id"), generated_id)))
    order = F.struct(F.col("order_id"), F.col("o.customer_id").alias("customer_id"), F.lit(C.STATUS_PENDING).alias("status"),
                     F.col("o.items").alias("items"), (F.current_timestamp() if now is None else now).alias("created_at"))
    r = r.withColumn("body", F.when(F.col("ok"), codec.encode_order(order)))
    r = r.withColumn("message_id", F.when(F.col("ok"), F.expr("uuid()") if message_id is None else message_id))
    status = (F.when(~F.col("ok"), 400).when(~F.lit(topic), 503)
               .when(F.octet_length("body") > C.MAX_MESSAGE_BYTES, 500).otherwise(202))
    error = (F.when(~F.col("ok"), C.ERR_INVALID_INPUT).when(~F.lit(topic), C.ERR_NO_TOPIC)
              .when(F.octet_length("body") > C.MAX_MESSAGE_BYTES, C.ERR_PUBLISH_FAILED))
    return r.select(*rest, status.alias("status_code"), error.alias("error"), "order_id", "message_id",
                    F.when(F.col("ok"), F.create_map(F.lit("order_id"), F.col("order_id"))).alias("attributes"), "body")


def accept(requests: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """T1 as two DataFrames: messages to publish, rejected requests."""
    rows = judged(requests, **kw)
    return (rows.where("status_code = 202").drop("status_code", "error"),
            rows.where("status_code <> 202").drop("attributes", "body"))


def envelope_json(messages: DataFrame) -> DataFrame:
    """S9 wire format: one JSON line per message."""
    return messages.select(F.to_json(F.struct("message_id", "attributes", "body")).alias("value"))


def write_once(df: DataFrame, path: str, fmt: str, **options) -> None:
    """Write a folder unless an earlier try of the same batch finished it."""
    fs, done = _fs(df.sparkSession, os.path.join(path, "_SUCCESS"))
    if not fs.exists(done):
        df.write.mode("overwrite").format(fmt).options(**options).save(path)


def _started(df: DataFrame, sink, checkpoint: str, available_now: bool, mode: str = "append") -> StreamingQuery:
    w = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def publish(requests: DataFrame, judge, queue_dirs: list[str], rejected_dir: str, checkpoint: str,
            available_now: bool = True, records_per_file: int = 0) -> StreamingQuery:
    """Judge each micro-batch of requests once, write its messages
    to every subscribed queue folder (raw delivery, no filter) and its
    rejected requests to ``rejected_dir``. ``judge``: requests to the rows of
    ``judged``. The judged rows are a written table, so a batch that is tried
    again after one of the folders was finished gives the others the same ids
    and times. ``records_per_file`` 10 with one file a trigger is the
    service's receive limit (L4)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        # a request takes far more work than its bytes tell: dealt over all cores
        rows = judge(batch.repartition(2 * batch.sparkSession.sparkContext.defaultParallelism))
        kept = os.path.join(f"{checkpoint.rstrip('/')}-judged", f"batch={batch_id}")
        write_once(rows, kept, "parquet")
        rows = batch.sparkSession.read.schema(rows.schema).parquet(kept)
        lines = envelope_json(rows.where("status_code = 202"))
        for q in queue_dirs:
            write_once(lines, os.path.join(q, f"batch={batch_id}"), "text", maxRecordsPerFile=records_per_file)
        write_once(rows.where("status_code <> 202").drop("attributes", "body"), os.path.join(rejected_dir, f"batch={batch_id}"), "parquet")

    return _started(requests, sink, checkpoint, available_now)


def received(queue: DataFrame) -> DataFrame:
    """T2 S7 F11 on queue messages: each decoded once; ``reason`` is null, or
    why the message is dead (T4: no body, too large, not decodable). ``key``
    names an order, or a message whose order has no id; it is null where a
    message has neither, so nothing can tell a redelivery of it."""
    m = codec.decode_rows(queue, "body", "order", strict=True).withColumnRenamed("value", "o")
    reason = (F.when(F.col("body").isNull(), "no body").when(F.octet_length("body") > C.MAX_MESSAGE_BYTES, "too large").when(~F.col("ok"), "decode"))
    key = (F.when(F.col("o.order_id") != "", F.concat(F.lit("order "), F.col("o.order_id")))
            .when(F.coalesce("message_id", F.lit("")) != "", F.concat(F.lit("message "), F.col("message_id"))))
    return m.select(key.alias("key"), "message_id", reason.alias("reason"), "raw", "enqueued_at", F.col("o.order_id").alias("order_id"),
                    F.col("o.customer_id").alias("customer_id"), F.when(reason.isNull(), F.lit(C.STATUS_COMPLETED)).alias("status"),
                    O.item_count("o.items").alias("n_items"), F.col("o.created_at").alias("created_at"),
                    F.coalesce(F.try_element_at("attributes", F.lit("attempt")).try_cast("int"), F.lit(0)).alias("attempt"))


def first_deliveries(good: DataFrame, *, horizon: str = RETENTION) -> DataFrame:
    """Redeliveries of a key within the horizon go; messages without a key
    pass, and take no state."""
    known = good.where("key is not null").withWatermark("enqueued_at", horizon).dropDuplicatesWithinWatermark(["key"])
    return known.unionByName(good.where("key is null"))


COMPLETED = ["order_id", "customer_id", "status", "n_items", "created_at", "message_id", "attempt"]
DEAD = ["message_id", "reason", "raw", "enqueued_at"]
GOOD = ("key string, message_id string, enqueued_at timestamp, order_id string, customer_id bigint, status string, n_items bigint, created_at timestamp, attempt int")


def split_queue(queue: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """The messages of a queue stream, decoded once per batch, to
    ``received`` (good) and ``dead_letter``. Dead messages never reach the
    de-duplication state; all of them are kept."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = received(batch).persist()
        good = [c.split()[0] for c in GOOD.split(", ")]
        write_once(rows.where("reason is null").select(*good), os.path.join(out_dir, "received", f"batch={batch_id}"), "parquet")
        write_once(rows.where("reason is not null").select(*DEAD), os.path.join(out_dir, "dead_letter", f"batch={batch_id}"), "parquet")
        rows.unpersist()

    return _started(queue, sink, checkpoint, available_now)


def complete_received(spark: SparkSession, out_dir: str, checkpoint: str, available_now: bool = True, *,
                      horizon: str = RETENTION) -> StreamingQuery:
    """The good messages that ``split_queue`` wrote, every order
    once, to ``completed``."""
    path = os.path.join(out_dir, "received")
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    done = first_deliveries(spark.readStream.schema(GOOD).parquet(path).select(*[c.split()[0] for c in GOOD.split(", ")]), horizon=horizon)

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_once(batch.select(*COMPLETED), os.path.join(out_dir, "completed", f"batch={batch_id}"), "parquet")

    return _started(done, sink, checkpoint, available_now)


def run_processor(queue: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True, *,
                  horizon: str = RETENTION) -> list[StreamingQuery]:
    """Both consumer queries; with ``available_now`` the
    second starts when the first has drained."""
    split = split_queue(queue, out_dir, os.path.join(checkpoint, "split"), available_now)
    if available_now:
        split.awaitTermination()
    return [split, complete_received(queue.sparkSession, out_dir, os.path.join(checkpoint, "complete"), available_now, horizon=horizon)]


def drain(queries: list[StreamingQuery] | StreamingQuery) -> None:
    """Wait until every (availableNow) query has processed its input."""
    for q in queries if isinstance(queries, list) else [queries]:
        q.awaitTermination()


def latest_versions(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """Read an update-mode sink written per batch id; keep the newest row per key."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in key and c != "batch"]
    agg = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_v"))
    return agg.select(*key, *[F.col("_v").getField(c).alias(c) for c in rest])


def run_update_sink(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Update-mode aggregation written per batch id (drained with availableNow)."""
    return _started(df, lambda batch, i: write_once(batch, os.path.join(out, f"batch={i}"), "parquet"), checkpoint, True, "update")


def run_append_sink(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Rows that are told once, written per batch id (drained with availableNow)."""
    return _started(df, lambda batch, i: write_once(batch, os.path.join(out, f"batch={i}"), "parquet"), checkpoint, True)


# --- Kafka wire format (S9/S10 with a broker) ---------------------------------
# The Kafka connector is not bundled with PySpark; these functions need the
# spark-sql-kafka package on the classpath. Only the record mapping is tested
# here (no broker is started).

def to_kafka_records(messages: DataFrame) -> DataFrame:
    """Envelope -> Kafka record: key = order_id attribute, value = body,
    headers = every attribute plus the message id (as binary values)."""
    attrs = F.map_concat(F.col("attributes"),
                         F.create_map(F.lit("message_id"), F.col("message_id")))
    headers = F.transform(F.map_entries(attrs), lambda e: F.struct(
        e["key"].alias("key"), e["value"].cast("binary").alias("value")))
    return messages.select(F.col("attributes")["order_id"].alias("key"), F.col("body").alias("value"),
                           headers.alias("headers"))


def from_kafka_records(records: DataFrame) -> DataFrame:
    """Kafka record (key, value, headers) -> envelope columns used by ``process``."""
    entries = F.transform(F.coalesce(F.col("headers"), F.array()),
                          lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value")))
    attrs = F.map_from_entries(F.filter(entries, lambda e: e["key"] != "message_id"))
    mid = F.element_at(F.filter(entries, lambda e: e["key"] == "message_id"), 1)["value"]
    enqueued = [F.col("timestamp").alias("enqueued_at")] if "timestamp" in records.columns else []
    return records.select(mid.alias("message_id"), attrs.alias("attributes"),
                          F.col("value").cast("string").alias("body"),
                          F.col("value").cast("string").alias("raw"), *enqueued)


def kafka_queue_stream(spark: SparkSession, servers: str, topic: str,
                       max_offsets_per_trigger: int | None = None) -> DataFrame:
    """S10/L4 from Kafka: envelopes with headers, rate-limited by offsets."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("includeHeaders", "true"))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return from_kafka_records(r.load())


def kafka_publish(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """S9 to Kafka (key = order_id, headers = attributes)."""
    return (to_kafka_records(messages).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())
