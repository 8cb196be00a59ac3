"""JSON decode/encode of products and orders.

Decoding follows Go's ``encoding/json`` as closely as Spark's built-in
expressions allow (all JVM-side):
  * type mismatches, out-of-range integers, truncated text, arrays and
    scalars at top level are errors (``from_json`` corrupt record);
  * a JSON ``null`` document decodes to zero values without error;
  * a number where a string field is expected is an error: string fields
    are parsed as Variant and their JSON type is checked (Spark alone
    would turn the number into text);
  * duplicate keys: the last one wins;
  * keys and strings need double quotes; NaN and infinities, bare or quoted,
    are no numbers;
  * times have 0 to 9 fraction digits, cut to microseconds;
  * absent fields are zero values, also inside items, and a null item is an
    item of zero values;
  * strict decoding (one whole document, ``json.Unmarshal``) rejects any
    trailing text; lenient decoding (``Decoder.Decode``, first value
    only) tolerates it;
  * a key that differs from a field's name in letter case only is that
    field; of repeated keys, in whatever case, the last one wins;
  * numbers beyond a double's range are errors;
  * white space around a document is space, tab, line feed, carriage return.

``decode_rows`` parses each row once: text and parse are computed in one
projection and the verdict by a generator, which Catalyst does not inline
into a filter (a plain filter on the flag would parse every row twice).
Higher-order functions are avoided on this path: they run outside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ORDER, PRODUCT, zero_fill

CORRUPT = "_corrupt_record"
# written with microseconds; read with 0 to 9 fraction digits (the rest of
# a nanosecond time is cut off)
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"
TS_READ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX"
WHITE = " \t\r\n"
PRODUCT_STRINGS = ["sku", "manufacturer", "name", "category", "description", "brand"]
ORDER_STRINGS = ["order_id", "status"]
ORDER_TIMES = ["created_at"]


def _names(schema: T.StructType) -> list[str]:
    """The names of a schema's fields, and of those of its items."""
    inner = [f.dataType.elementType for f in schema.fields if isinstance(f.dataType, T.ArrayType)]
    return [f.name for f in schema.fields] + [n for s in inner if isinstance(s, T.StructType) for n in _names(s)]


def fold_keys(t: Column, schema: T.StructType) -> Column:
    """The text with its keys in the schema's spelling, where they differ in
    case only. A quoted name before a colon is a key: inside a string its
    quotes would be escaped. Texts without such a key pass unchanged after
    one look; a renamed key keeps its place, so the last one still wins."""
    names = _names(schema)
    key = r'(?<!\\)"%s"(?=[ \t\r\n]*:)'
    other = key % ("(?!(?:" + "|".join(names) + ")\")(?iu:" + "|".join(names) + ")")
    folded = t
    for n in names:
        folded = F.regexp_replace(folded, key % f"(?iu:{n})", f'"{n}"')
    return F.when(t.rlike(other), folded).otherwise(t)


def _wire_schema(schema: T.StructType, variants: list[str]) -> T.StructType:
    fields = [T.StructField(f.name, T.VariantType()) if f.name in variants else f
              for f in schema.fields]
    return T.StructType(fields + [T.StructField(CORRUPT, T.StringType())])


def _all(cs: list[Column]) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & c
    return out


def _spec(kind: str, strict: bool | None):
    if kind == "product":
        return PRODUCT, True, PRODUCT_STRINGS, []
    return ORDER, bool(strict), ORDER_STRINGS, ORDER_TIMES


def _parse(t: Column, schema: T.StructType, strings: list[str], times: list[str]) -> Column:
    wire = _wire_schema(schema, strings + times)
    return F.from_json(t, wire, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
                                 "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})


def _judge(t: Column, p: Column, schema: T.StructType, strict: bool, strings: list[str],
           times: list[str], ts_format: str = TS_READ_FORMAT) -> Column:
    """struct<ok boolean, value struct> from the text ``t`` and its parse ``p``."""
    def vtype(n):
        return F.schema_of_variant(p.getField(n))

    def as_string(n):
        return F.when(vtype(n) == "STRING", F.variant_get(p.getField(n), "$", "string"))

    typed = {n: as_string(n) for n in strings}
    ts_text = {n: as_string(n) for n in times}
    typed.update({n: F.try_to_timestamp(ts_text[n], F.lit(ts_format)) for n in times})
    # a number out of a double's range is read as infinite
    numbers = [p.getField(f.name).getField(g.name) for f in schema.fields if isinstance(f.dataType, T.ArrayType)
               for g in f.dataType.elementType.fields if isinstance(g.dataType, T.DoubleType)]
    endless = [F.coalesce(F.array_contains(n, F.lit(float(x))), F.lit(False)) for n in numbers for x in ("inf", "-inf")]
    types_ok = _all([~e for e in endless]) & _all([p.getField(n).isNull() | vtype(n).isin("STRING", "VOID") for n in strings + times])
    times_ok = _all([ts_text[n].isNull() | typed[n].isNotNull() for n in times])
    trimmed = F.trim(t, F.lit(WHITE))
    null_doc = trimmed == "null" if strict else trimmed.startswith("null")
    ok = (t.isNotNull() & (trimmed != "") & p.isNotNull()
          & (p.getField(CORRUPT).isNull() | null_doc) & types_ok & times_ok)
    if strict:
        whole = F.json_array_length(F.concat(F.lit("["), t, F.lit("]")))
        ok = ok & F.coalesce(whole == 1, F.lit(False))
    ok = F.coalesce(ok, F.lit(False))
    fields = F.struct(*[(typed[f.name] if f.name in typed else p.getField(f.name)).alias(f.name)
                        for f in schema.fields])
    return F.struct(ok.alias("ok"), F.when(ok, zero_fill(fields, schema)).alias("value"))


def _col(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def product_struct(text: str | Column) -> Column:
    """Decoded product as one expression (use within a single projection)."""
    schema, strict, strings, times = _spec("product", None)
    t = fold_keys(_col(text), schema)
    return _judge(t, _parse(t, schema, strings, times), schema, strict, strings, times)


def order_struct(text: str | Column, *, strict: bool) -> Column:
    """Decoded order as one expression (use within a single projection)."""
    schema, strict, strings, times = _spec("order", strict)
    t = fold_keys(_col(text), schema)
    return _judge(t, _parse(t, schema, strings, times), schema, strict, strings, times)


def decode_product(text: str | Column) -> tuple[Column, Column]:
    """Strict product decode -> (zero-filled value or NULL, ok)."""
    d = product_struct(text)
    return d.getField("value"), d.getField("ok")


def decode_order(text: str | Column, *, strict: bool) -> tuple[Column, Column]:
    """S6 (strict=False, request side) / S7 (strict=True, consumer side)."""
    d = order_struct(text, strict=strict)
    return d.getField("value"), d.getField("ok")


def decode_rows(df: DataFrame, text: str | Column, kind: str, *, strict: bool | None = None) -> DataFrame:
    """Add ``ok`` and ``value`` columns, parsing each row once.

    The text and its parse are computed in one projection (common
    subexpressions are shared there, inside whole-stage codegen); the
    verdict is produced by a generator, which Catalyst does not inline
    into later filters on ``ok``."""
    schema, strict_, strings, times = _spec(kind, strict)
    staged = df.select("*", fold_keys(_col(text), schema).alias("_t"))
    staged = staged.select("*", _parse(F.col("_t"), schema, strings, times).alias("_p"))
    verdict = _judge(F.col("_t"), F.col("_p"), schema, strict_, strings, times)
    return staged.select(*[F.col(c) for c in df.columns], F.inline(F.array(verdict)))


def encode(struct_col: Column, timestamp_format: str = TS_FORMAT) -> Column:
    """Compact JSON text of a struct (NULL fields omitted)."""
    return F.to_json(struct_col, {"timestampFormat": timestamp_format})


#: The zero time, as the service writes it.
ZERO_TIME = "0001-01-01 00:00:00+00:00"


def encode_order(order: Column, timestamp_format: str = TS_FORMAT) -> Column:
    """JSON text of an order with all its fields: absent ones are written
    as zero values (the zero time, ``null`` for absent items)."""
    field = {f.name: order.getField(f.name) for f in ORDER.fields}
    zero = {"order_id": F.lit(""), "status": F.lit(""), "customer_id": F.lit(0).cast("bigint"), "created_at": F.lit(ZERO_TIME).cast("timestamp")}
    full = F.struct(*[(F.coalesce(c, zero[n]) if n in zero else c).alias(n) for n, c in field.items()])
    return F.to_json(full, {"timestampFormat": timestamp_format, "ignoreNullFields": "false"})


def split_decoded(df: DataFrame, text: str | Column, kind: str, *,
                  strict: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows with ``value``, poison rows without)."""
    rows = decode_rows(df, text, kind, strict=strict)
    return rows.where("ok").drop("ok"), rows.where(~F.col("ok")).drop("ok", "value")
