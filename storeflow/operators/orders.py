"""Order operators (P6-P10, P13, J6, T3, T5, T6, F11) in batch form.

Orders are nested records ``order_id, customer_id, status, items
array<struct<product_id, quantity, price>>, created_at``. The same
column functions are used by the streaming pipeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..schemas import ORDER_FIELDS


def nest_lines(lines: DataFrame, key: str, item: Column, place: Column | None = None) -> DataFrame:
    """Nest order lines into one item array per key, in one shuffle, ordered
    by ``place`` (lines of one place, or all without it, by their content).

    ``item`` is a struct column per line. An order document is one record
    by definition (one message, one response), so a key's lines meet in one
    row; queries that need only counts or sums aggregate the lines instead."""
    placed = F.sort_array(F.collect_list(F.struct((F.lit(0) if place is None else place).alias("place"), item.alias("item"))))
    return lines.groupBy(key).agg(placed.getField("item").alias("items"))


def item_count(items: str | Column = "items") -> Column:
    """``len(items)`` with Go's len(nil) = 0."""
    c = F.col(items) if isinstance(items, str) else items
    return F.coalesce(F.size(c), F.lit(0)).cast("bigint")


def default_order_id(order_id: str | Column = "order_id", generated: Column | None = None) -> Column:
    """Keep a non-empty order id, else generate one (uuid by default)."""
    c = F.col(order_id) if isinstance(order_id, str) else order_id
    gen = F.expr("uuid()") if generated is None else generated
    return F.when(F.coalesce(c, F.lit("")) == "", gen).otherwise(c)


def stamp(orders: DataFrame, status: str, now: Column | None = None) -> DataFrame:
    """Overwrite status and created_at (client values are ignored)."""
    ts = F.current_timestamp() if now is None else now
    return orders.withColumn("status", F.lit(status)).withColumn("created_at", ts)


def complete(orders: DataFrame) -> DataFrame:
    """Mark processed orders completed."""
    return orders.withColumn("status", F.lit(C.STATUS_COMPLETED))


def sync_response(orders: DataFrame, *extra: str) -> DataFrame:
    """P10 (sync): message, order_id, status (plus pass-through columns)."""
    return orders.select(F.lit(C.MSG_ORDER_SYNC).alias("message"), "order_id", "status", *extra)


def async_response(orders: DataFrame, message_id: Column) -> DataFrame:
    """P10 (async): message, order_id, status, message_id."""
    return orders.select(F.lit(C.MSG_ORDER_ASYNC).alias("message"), "order_id", "status",
                         message_id.alias("message_id"))


def unnest(orders: DataFrame, keep: list[str] | None = None, outer: bool = False) -> DataFrame:
    """One row per item with its position. Orders without items vanish,
    or (``outer=True``) keep one row with NULL item columns."""
    keep = keep or ["order_id"]
    gen = F.posexplode_outer("items") if outer else F.posexplode("items")
    return (orders.select(*keep, gen.alias("line_no", "item"))
                  .select(*keep, "line_no", "item.product_id", "item.quantity", "item.price"))


def process_sync(decoded: DataFrame, now: Column | None = None,
                 generated_id: Column | None = None) -> DataFrame:
    """T5: decoded order requests -> default id -> processing -> completed."""
    o = decoded.withColumn("order_id", default_order_id("order_id", generated_id))
    o = stamp(o, C.STATUS_PROCESSING, now)
    return complete(o)


def sync_answers(requests: DataFrame, now: Column | None = None, generated_id: Column | None = None,
                 body: str = "body") -> DataFrame:
    """T5 from body to answer: status_code 200 with the sync response, or 400
    with the error record, and the other columns of the request."""
    from ..functions.scalars import error_record
    from ..sources import codec
    rest = [c for c in requests.columns if c not in (body, *ORDER_FIELDS)]
    r = codec.decode_rows(requests.select(*rest, F.col(body).alias("_body")), "_body", "order", strict=False)
    done = process_sync(r.select(*rest, "ok", "value.*"), now, generated_id)
    answer = F.struct(F.lit(C.MSG_ORDER_SYNC).alias("message"), "order_id", "status")
    error = error_record(C.ERR_INVALID_INPUT, C.MSG_INVALID_BODY, "malformed JSON body")
    return done.select(*rest, F.when(F.col("ok"), 200).otherwise(400).alias("status_code"),
                       F.when(F.col("ok"), F.to_json(answer)).otherwise(F.to_json(error)).alias("response_body"))


def latest_status(events: DataFrame, key: str, status: str, seq: str) -> DataFrame:
    """Current status per key from lifecycle events (partial ``max_by``)."""
    return events.groupBy(key).agg(F.max_by(status, seq).alias("status"),
                                   F.max(seq).alias("last_seq"))


def first_delivery(messages: DataFrame, key: list[str], seq: str) -> DataFrame:
    """T3 (batch): one row per message key, the first delivery, with the
    number of deliveries (partial aggregation, skew-safe)."""
    return messages.groupBy(*key).agg(F.min(seq).alias("first_seq"),
                                      F.count(F.lit(1)).cast("bigint").alias("deliveries"))


def order_struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in ORDER_FIELDS])


def retained(df: DataFrame, ts: str, as_of: Column, seconds: int = C.RETENTION_SECONDS) -> DataFrame:
    """F10 (batch): keep messages younger than the queue's retention at
    ``as_of`` (a literal keeps the predicate pushable to the scan)."""
    return df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {seconds} SECONDS"))
