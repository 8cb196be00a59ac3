"""Canonical schemas and zero-fill (absent JSON fields become zero values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRODUCT = T.StructType([
    T.StructField("product_id", T.IntegerType()),
    T.StructField("sku", T.StringType()),
    T.StructField("manufacturer", T.StringType()),
    T.StructField("category_id", T.IntegerType()),
    T.StructField("weight", T.IntegerType()),
    T.StructField("some_other_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("brand", T.StringType()),
])
PRODUCT_FIELDS = [f.name for f in PRODUCT.fields]

ITEM = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("price", T.DoubleType()),
])

ORDER = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("items", T.ArrayType(ITEM)),
    T.StructField("created_at", T.TimestampType()),
])
ORDER_FIELDS = [f.name for f in ORDER.fields]

ERROR = T.StructType([
    T.StructField("error", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("details", T.StringType()),
])

SEARCH_REQUEST = "query_id BIGINT, q STRING, max_check INT, max_results INT"
PRODUCT_REQUEST = "request_id BIGINT, method STRING, product_id_text STRING, body STRING"
REQUEST_LOG = ("method STRING, name STRING, status_code INT, response_body STRING, "
               "elapsed_ms DOUBLE, ts TIMESTAMP")
QUEUE_SAMPLES = "run STRING, ts TIMESTAMP, visible BIGINT, not_visible BIGINT"


def _zero(dt: T.DataType) -> Column:
    if isinstance(dt, T.StringType):
        return F.lit("")
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.lit(0).cast(dt)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.lit(0.0).cast(dt)
    if isinstance(dt, T.ArrayType):
        return F.array().cast(dt)
    if isinstance(dt, T.TimestampType):
        # Go's zero time has no useful Spark value; it stays NULL (services
        # stamp created_at before use).
        return F.lit(None).cast(dt)
    raise TypeError(f"no zero value for {dt}")


def _fill_elements(array: Column, element: T.StructType) -> Column:
    return F.transform(array, lambda x: zero_fill(x, element))


def zero_fill(struct_col: Column, schema: T.StructType, skip: tuple[str, ...] = ()) -> Column:
    """Rebuild a decoded struct with Go zero values for absent fields."""
    parts = []
    for f in schema.fields:
        v = struct_col.getField(f.name)
        if f.name in skip:
            parts.append(v.alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            parts.append(F.coalesce(_fill_elements(v, f.dataType.elementType), _zero(f.dataType)).alias(f.name))
        else:
            parts.append(F.coalesce(v, _zero(f.dataType)).alias(f.name))
    return F.struct(*parts)
