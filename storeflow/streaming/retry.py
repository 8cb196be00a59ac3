"""T4: dead letters tried again until their retention ends.

A dead letter is redelivered round by round. A round takes the letters that
are still pending and those the consumer has added since, lets ``repair`` offer
a new body, and decodes it: letters that decode now go back to the queue with
their number of attempts, letters older than the retention expire, the others
wait for the next round with one attempt more. Everything is a table of its
round: no streaming state is held per dead message, and a round that is tried
again reads the judgement it wrote first, so a letter is requeued or expired
exactly once.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..sources import codec
from . import orders_stream as ST

LETTER = "message_id string, reason string, raw string, enqueued_at timestamp, attempts int, batch int"
JUDGED = "message_id string, attributes map<string,string>, body string, reason string, raw string, enqueued_at timestamp, attempts int, batch int, outcome string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    fs, p = ST._fs(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], schema)


def pending(spark: SparkSession, out_dir: str, round_no: int) -> DataFrame:
    """The letters that round ``round_no`` takes: those left by the round
    before, and dead letters of batches that no round has taken yet."""
    left = _table(spark, os.path.join(out_dir, "retry", f"round={round_no - 1}"), JUDGED).where("outcome = 'pending'")
    dead = _table(spark, os.path.join(out_dir, "dead_letter"), LETTER)
    taken = None
    for k in range(round_no):  # one scalar a round
        high = _table(spark, os.path.join(out_dir, "retry", f"round={k}"), JUDGED).agg(F.max("batch")).first()[0]
        taken = high if taken is None else max(taken, taken if high is None else high)
    new = dead if taken is None else dead.where(F.col("batch") > taken)
    names = [c.split()[0] for c in LETTER.split(", ")]
    return left.select(*names).unionByName(new.withColumn("attempts", F.coalesce("attempts", F.lit(0))).select(*names))


def run_round(spark: SparkSession, out_dir: str, queue_dir: str, round_no: int, now: Column, repair: Callable[[DataFrame], Column],
              keep_s: int = C.RETENTION_SECONDS) -> None:
    """One round at the time ``now``. ``repair``: from the letters (with the
    envelope's ``body``) to the body to try now, null where there is none."""
    path = os.path.join(out_dir, "retry", f"round={round_no}")
    m = pending(spark, out_dir, round_no).withColumn("m", F.from_json("raw", ST.ENVELOPE))
    m = m.withColumn("body", F.col("m.body")).withColumn("attempts", F.col("attempts") + 1)
    m = m.withColumn("fixed", repair(m))
    m = codec.decode_rows(m, "fixed", "order", strict=True)
    good = F.col("ok") & (F.octet_length("fixed") <= C.MAX_MESSAGE_BYTES)
    age = F.unix_micros(now) - F.unix_micros("enqueued_at")
    outcome = F.when(good, "requeued").when(age >= keep_s * 1_000_000, "expired").otherwise("pending")
    attempt = F.create_map(F.lit("attempt"), F.col("attempts").cast("string"))
    old = F.map_filter(F.coalesce("m.attributes", F.create_map().cast("map<string,string>")), lambda k, v: k != "attempt")
    ST.write_once(m.select("message_id", F.map_concat(old, attempt).alias("attributes"), F.when(good, F.col("fixed")).alias("body"),
                           "reason", "raw", "enqueued_at", "attempts", "batch", outcome.alias("outcome")), path, "parquet")
    judged = spark.read.schema(JUDGED).parquet(path)
    again = judged.where("outcome = 'requeued'").select("message_id", "attributes", "body")
    ST.write_once(ST.envelope_json(again), os.path.join(queue_dir, f"retry={round_no}"), "text")


def expired(spark: SparkSession, out_dir: str) -> DataFrame:
    """The letters whose retention ended, with their attempts and last text."""
    return _table(spark, os.path.join(out_dir, "retry"), JUDGED).where("outcome = 'expired'").select("message_id", "reason", "raw", "attempts")
