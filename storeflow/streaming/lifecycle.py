"""Keyed state with event-time timers, and measured elapsed times.

* ``latest_status`` (T6): the current status of every key; a key unseen for
  the retention time expires: it is reported once as expired and its state
  goes, so state is bounded by the keys of one retention time.
* ``final_windows`` (A11): arrivals per window, told once, when the watermark
  has passed the window; rows that come later are told as late. Every row is
  counted in exactly one of the two.
* ``elapsed`` (P11): arrivals joined to their completions within a time
  bound; an arrival without one is told once, when the bound has passed.

The state of a key is a few numbers. Timers run on the watermark, so
results do not depend on when a batch runs, and ``availableNow`` drains: its
last batch, without data, fires the timers that are due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from .. import constants as C
from ..session import python_workers

RETENTION_MS = C.RETENTION_SECONDS * 1000


#: The state of the keys of one bucket; ``due`` is when the key expires.
HELD = ["key", "status", "seq", "last_ms", "due"]


def _latest(keep_ms: int):
    """The update of one bucket of keys: of each key the row of the greatest
    seq is kept, until ``keep_ms`` after the latest time seen."""
    def frame(columns, touched: int) -> pd.DataFrame:
        rows = pd.DataFrame(dict(zip(HELD, columns)), columns=HELD).astype({"key": object, "status": object, "seq": "int64", "last_ms": "int64", "due": "int64"})
        return rows.assign(touched=touched)

    def newest_of(rows: pd.DataFrame) -> pd.DataFrame:
        high = rows.groupby("key", sort=False)[["last_ms", "due", "touched"]].transform("max")
        rows = rows.assign(last_ms=high["last_ms"], due=high["due"], touched=high["touched"], rank=[s or "" for s in rows["status"]])
        return rows.sort_values(["seq", "rank"], ascending=False, kind="stable").drop_duplicates("key").drop(columns="rank")

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        rows = [frame(state.get if state.exists else [[]] * len(HELD), 0)]
        for part in parts:
            if len(part):
                status = [None if pd.isna(s) else s for s in part["status"]]
                part = newest_of(frame([part["key"], pd.Series(status, part.index, object), part["seq"], part["ms"], (part["ms"] + keep_ms).clip(lower=now + 1)], 1))
                rows.append(part)
        rows = newest_of(pd.concat(rows, ignore_index=True))
        gone = (rows["touched"] == 0) & (rows["due"] < now)
        kept = rows[~gone]
        if len(kept):
            state.update(tuple(kept[c].tolist() for c in HELD))
            state.setTimeoutTimestamp(int(kept["due"].min()))
        else:
            state.remove()
        told = gone | (rows["touched"] == 1)
        yield rows.assign(expired=gone)[told].rename(columns={"seq": "last_seq"})[["key", "status", "last_seq", "last_ms", "expired"]]

    return update


def latest_status(events: DataFrame, keys: list[str], *, keep_ms: int = RETENTION_MS, delay: str = "1 hour", buckets: int = 512) -> DataFrame:
    """``events`` (stream: keys, status, seq, ts) to one row per key and
    batch that touched it: status, last_seq, last_ms, expired. Of rows of one
    seq the greatest status counts; events older than the watermark are
    dropped by the engine; a key that returns after it expired starts anew, one
    that returns in the batch in which it would expire goes on. Keys are dealt
    over ``buckets`` by a hash; a bucket's keys are updated together, as the
    call of a state's function takes far longer than a key in it."""
    python_workers(events.sparkSession)
    key = F.to_json(F.struct(*keys))
    timed = (events.withWatermark("ts", delay).select(key.alias("key"), "status", "seq", "ts", F.unix_millis("ts").alias("ms"))
                   .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")))
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    told = timed.groupBy("bucket").applyInPandasWithState(
        _latest(keep_ms), "key string, status string, last_seq long, last_ms long, expired boolean",
        "key array<string>, status array<string>, seq array<long>, last_ms array<long>, due array<long>", "append", "EventTimeTimeout")
    told = told.withColumn("key", F.from_json("key", ", ".join(f"{k} {types[k]}" for k in keys)))
    return told.select(*[F.col("key").getField(k).alias(k) for k in keys], "status", "last_seq", "last_ms", "expired")


def newest(spark, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The last row told of every key, from folders written per batch; of one
    batch the expiry comes last."""
    df = spark.read.schema(f"{schema}, batch int").parquet(path)
    rest = [c for c in df.columns if c not in keys and c != "batch"]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", "expired")).alias("_v"))
    return last.select(*keys, *[F.col("_v").getField(c).alias(c) for c in rest])


class FinalWindows(StatefulProcessor):
    """One window of one key: its count until the watermark passes it."""

    def __init__(self, keys: list[str], width_ms: int):
        self.keys, self.width_ms = keys, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("count", "n long")

    def _row(self, key: tuple, n: int, late: bool) -> pd.DataFrame:
        row = dict(zip(self.keys, key)) | {"arrivals": n, "late": late}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, end = sum(len(part) for part in rows), int(key[-2]) + self.width_ms
        if end <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, n, True)
            return
        if self.state.exists():
            self.state.update((int(self.state.get()[0]) + n,))
        else:
            self.handle.registerTimer(end)
            self.state.update((n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = int(self.state.get()[0])
        self.state.clear()
        yield self._row(key, n, False)

    def close(self) -> None:
        pass


def final_windows(events: DataFrame, by: list[str], width_ms: int, *, delay: str = "1 day", buckets: int = 4) -> DataFrame:
    """``events`` (stream: by, ts) to counts per tumbling window
    (``window_ms``, its start): rows with ``late`` false once a window is
    final, and with ``late`` true for what came after the watermark had passed
    it. A window is dealt over ``buckets`` keys by a hash of the row's time, so
    a hot one is not one task; a reader adds them up. The time column itself
    does not go on to the state, else the engine would drop late rows unseen."""
    python_workers(events.sparkSession)
    keys = [*by, "window_ms", "bucket"]
    start = F.floor(F.unix_millis("ts") / F.lit(width_ms)).cast("bigint") * F.lit(width_ms)
    timed = events.withWatermark("ts", delay).select(*by, start.alias("window_ms"), F.pmod(F.xxhash64("ts"), F.lit(buckets)).cast("int").alias("bucket"))
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in by), "window_ms long, bucket int, arrivals long, late boolean"])
    return timed.groupBy(*keys).transformWithStateInPandas(FinalWindows(keys, width_ms), schema, "Append", "EventTime")


def elapsed(arrivals: DataFrame, completions: DataFrame, key: str, within_s: int, *, delay: str = "1 day") -> DataFrame:
    """P11 on streams: ``arrivals`` (key, arrived_at, ...) with each of their
    ``completions`` (key, completed_at, ...) from 0 to ``within_s`` seconds
    later and the measured ``elapsed_ms``; an arrival without one comes once,
    with nulls, when the watermark of both sides has passed its bound. Both
    sides hold state for that long only."""
    a = arrivals.withWatermark("arrived_at", delay)
    c = completions.withWatermark("completed_at", delay).withColumnRenamed(key, "_done")
    within = F.expr(f"completed_at >= arrived_at and completed_at <= arrived_at + interval {int(within_s)} seconds")
    ms = (F.unix_micros("completed_at") - F.unix_micros("arrived_at")) / F.lit(1000.0)
    return a.join(c, (F.col(key) == F.col("_done")) & within, "leftOuter").withColumn("elapsed_ms", ms).drop("_done")
