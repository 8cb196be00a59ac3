"""Scalar rules: category ids, weights, templates, defaults, id parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

# Go's strconv.ParseInt(s, 10, 32): optional sign then decimal digits only.
# A regex guard is needed because a Spark cast trims surrounding spaces.
# \z: the very end; $ would also match before a final line break.
ID_TEXT_PATTERN = r"^[+-]?[0-9]+\z"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def category_id(category: str | Column) -> Column:
    """Category name -> id, unknown -> 1."""
    pairs = []
    for name, cid in C.CATEGORY_IDS.items():
        pairs += [F.lit(name), F.lit(cid)]
    lookup = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(lookup, col(category)),
                      F.lit(C.DEFAULT_CATEGORY_ID)).cast("int")


def generated_weight(product_id: str | Column) -> Column:
    """100 + id % 900."""
    return (F.lit(C.WEIGHT_BASE) + col(product_id) % F.lit(C.WEIGHT_MODULUS)).cast("int")


def cyclic_pick(values: list[str], product_id: str | Column) -> Column:
    """values[(id - 1) % n] (ids start at 1)."""
    return F.get(F.array(*[F.lit(v) for v in values]),
                 F.pmod(col(product_id) - 1, F.lit(len(values))).cast("int"))


def sku_of(product_id: str | Column) -> Column:
    """SKU-<id>."""
    return F.format_string(C.SKU_FORMAT, col(product_id))


def fold(text: str | Column) -> Column:
    """P5: lower-case folding used by search."""
    return F.lower(col(text))


def positive_or_default(value: str | Column, default: int) -> Column:
    """A non-positive, null or unparsable value becomes the default."""
    v = col(value).try_cast("int")
    return F.when(v > 0, v).otherwise(F.lit(default)).cast("int")


def parse_request_id(text: str | Column) -> Column:
    """base-10 32-bit id text with optional sign; NULL when unparsable.

    The returned value is the parsed integer (it may be < 1; see ``valid_id``).
    """
    t = col(text)
    return F.when(t.rlike(ID_TEXT_PATTERN), t.try_cast("int"))


def valid_id(parsed: str | Column) -> Column:
    """id >= 1 (NULL counts as invalid)."""
    return F.coalesce(col(parsed) >= 1, F.lit(False))


def error_record(code: str, message: str, details: str | Column | None = None) -> Column:
    """Error struct; empty details are dropped like ``omitempty``."""
    d = F.lit(details) if isinstance(details, str) or details is None else details
    return F.struct(F.lit(code).alias("error"), F.lit(message).alias("message"),
                    F.nullif(d.cast("string"), F.lit("")).alias("details"))


def elapsed_ms(start: str | Column, end: str | Column) -> Column:
    """Elapsed milliseconds between two timestamps."""
    return (F.unix_micros(col(end)) - F.unix_micros(col(start))) / F.lit(1000.0)


_EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_us(df_or_type, name: str | None = None) -> Column:
    """Epoch microseconds of a timestamp column, independent of the session
    time zone for TIMESTAMP_NTZ (wall-clock) columns.

    ``epoch_us(df, "ts")`` looks the type up in ``df``; ``epoch_us(T, col)``
    takes a data type and a column."""
    from pyspark.sql import types as T
    if isinstance(df_or_type, T.DataType):
        dt, c = df_or_type, name
    else:
        dt, c = df_or_type.schema[name].dataType, name
    column = F.col(c) if isinstance(c, str) else c
    if isinstance(dt, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), column)
    return F.unix_micros(column.cast("timestamp"))
