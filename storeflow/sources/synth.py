"""Deterministic synthetic traffic keyed by rows of a driver table.

Each generated record depends only on its key (Lehmer draws, see
``functions.hashing``), so the output is the same for any partitioning
and can be reproduced in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.hashing import draw_int

SALT_CUSTOMER, SALT_ITEMS, SALT_TERM, SALT_KIND, SALT_ID = 1, 2, 3, 4, 5
SALT_SKU, SALT_MANUFACTURER, SALT_CATEGORY, SALT_WEIGHT, SALT_OTHER = 6, 7, 8, 9, 10


def item_salt(i: Column | int, field: int) -> Column | int:
    """Salt of item i (1-based), field 0..2 (product, quantity, price)."""
    return i * 3 + 20 + field


def orders(keys: DataFrame, key: str) -> DataFrame:
    """One order per key: customer 1..10000, 1-3 items, product 1..1000,
    quantity 1..5, price 9.99..199.99 (2 decimals)."""
    k = F.col(key)
    n = draw_int(k, SALT_ITEMS, C.ORDER_ITEMS_MIN, C.ORDER_ITEMS_MAX)
    items = F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda i: F.struct(
        draw_int(k, item_salt(i, 0), C.ORDER_PRODUCT_MIN, C.ORDER_PRODUCT_MAX).alias("product_id"),
        draw_int(k, item_salt(i, 1), C.ORDER_QTY_MIN, C.ORDER_QTY_MAX).alias("quantity"),
        (draw_int(k, item_salt(i, 2), C.ORDER_PRICE_CENTS_MIN, C.ORDER_PRICE_CENTS_MAX) / F.lit(100.0))
        .alias("price")))
    return keys.select(
        k.alias("order_key"),
        draw_int(k, SALT_CUSTOMER, C.ORDER_CUSTOMER_MIN, C.ORDER_CUSTOMER_MAX).alias("customer_id"),
        items.alias("items"))


def search_requests(keys: DataFrame, key: str) -> DataFrame:
    """One search per key, term uniform over the load test's term list."""
    k = F.col(key)
    terms = F.array(*[F.lit(t) for t in C.LOAD_SEARCH_TERMS])
    idx = draw_int(k, SALT_TERM, 0, len(C.LOAD_SEARCH_TERMS) - 1).cast("int")
    return keys.select(k.alias("query_id"), F.get(terms, idx).alias("q"),
                       F.lit(C.DEFAULT_MAX_CHECK).alias("max_check"),
                       F.lit(C.DEFAULT_MAX_RESULTS).alias("max_results"))


def traffic_kinds() -> list[tuple[str, int, int]]:
    """(kind, first bucket, last bucket) over the cumulative weights."""
    out, lo = [], 0
    for kind, w in C.TRAFFIC_WEIGHTS:
        out.append((kind, lo, lo + w - 1))
        lo += w
    return out


def product_traffic(keys: DataFrame, key: str) -> DataFrame:
    """Weighted mix of product requests; health checks are dropped.

    get     -> an id in 1..1000 (stands in for the ids a user created)
    add     -> POST of a product body as the load test sends it
    missing -> an id in 900000..999999
    invalid -> one of the invalid id texts"""
    k = F.col(key)
    total = sum(w for _, w in C.TRAFFIC_WEIGHTS)
    bucket = draw_int(k, SALT_KIND, 0, total - 1)
    kind = None
    for name, lo, hi in traffic_kinds():
        cond = bucket.between(lo, hi)
        kind = F.when(cond, F.lit(name)) if kind is None else kind.when(cond, F.lit(name))
    add_id = draw_int(k, SALT_ID, *C.TRAFFIC_ADD_ID_RANGE)
    get_id = draw_int(k, SALT_ID, C.ORDER_PRODUCT_MIN, C.ORDER_PRODUCT_MAX)
    miss_id = draw_int(k, SALT_ID, *C.TRAFFIC_MISSING_ID_RANGE)
    bad = F.get(F.array(*[F.lit(v) for v in C.TRAFFIC_INVALID_IDS]),
                draw_int(k, SALT_ID, 0, len(C.TRAFFIC_INVALID_IDS) - 1).cast("int"))
    mans = F.array(*[F.lit(v) for v in C.TRAFFIC_MANUFACTURERS])
    body = F.to_json(F.struct(
        add_id.cast("int").alias("product_id"),
        F.format_string("SKU-%d-%d", add_id, draw_int(k, SALT_SKU, *C.TRAFFIC_SKU_SUFFIX_RANGE)).alias("sku"),
        F.get(mans, draw_int(k, SALT_MANUFACTURER, 0, len(C.TRAFFIC_MANUFACTURERS) - 1).cast("int"))
        .alias("manufacturer"),
        draw_int(k, SALT_CATEGORY, *C.TRAFFIC_CATEGORY_ID_RANGE).cast("int").alias("category_id"),
        draw_int(k, SALT_WEIGHT, *C.TRAFFIC_WEIGHT_RANGE).cast("int").alias("weight"),
        draw_int(k, SALT_OTHER, *C.TRAFFIC_OTHER_ID_RANGE).cast("int").alias("some_other_id")))
    df = keys.select(k.alias("request_id"), kind.alias("kind"), get_id.alias("get_id"),
                     add_id.alias("add_id"), miss_id.alias("miss_id"), bad.alias("bad_id"),
                     body.alias("add_body"))
    return df.where(F.col("kind") != "health").select(
        "request_id", "kind",
        F.when(F.col("kind") == "add", "POST").otherwise("GET").alias("method"),
        F.when(F.col("kind") == "get", F.col("get_id").cast("string"))
         .when(F.col("kind") == "add", F.col("add_id").cast("string"))
         .when(F.col("kind") == "missing", F.col("miss_id").cast("string"))
         .otherwise(F.col("bad_id")).alias("product_id_text"),
        F.when(F.col("kind") == "add", F.col("add_body")).alias("body"))
