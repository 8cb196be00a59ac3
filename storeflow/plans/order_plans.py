"""Order queries: nesting, JSON round trip, unnest, completion, status,
de-duplication, poison split, and synthetic traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..functions.hashing import draw_sql
from ..operators import orders as O
from ..operators import requests as RQ
from ..operators import search as SR
from ..sources import catalog, codec, synth, tables
from .registry import register


#: The product of an order line; what two suppliers in five deliver has a
#: number of their own, which the catalog does not know.
PRODUCT_ID = "case when l_suppkey % 5 < 2 then l_partkey + 1000000 else l_partkey end"


def _order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested order records built from ``orders`` and ``lineitem``."""
    li = tables.load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    item = F.struct(F.expr(PRODUCT_ID).alias("product_id"),
                    F.col("l_quantity").cast("bigint").alias("quantity"),
                    F.try_divide("l_extendedprice", "l_quantity").alias("price"))
    nested = O.nest_lines(li, "l_orderkey", item, F.col("l_linenumber"))
    o = tables.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    docs = o.join(nested, o["o_orderkey"] == nested["l_orderkey"], "left")
    return docs.select(F.col("o_orderkey").cast("string").alias("order_id"),
                       F.col("o_custkey").alias("customer_id"), F.lit("").alias("status"),
                       "items", F.timestamp_micros(S.epoch_us(o, "o_orderdate")).alias("created_at"))


def order_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order document's JSON request body."""
    docs = _order_documents(spark, sf_dir)
    return docs.select("order_id", codec.encode_order(O.order_struct(docs)).alias("body"))


def _decoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 then S6: encode each document as its JSON request body and decode it."""
    rows = codec.decode_rows(order_bodies(spark, sf_dir).select("body"), "body", "order", strict=False)
    return rows.where("ok").select("value.*")


def _catalog_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"))


LINE_PRICE_SQL = "case when l_quantity = 0 then null else l_extendedprice / l_quantity end"


@register("order_lines", f"""
with l as (select l_orderkey, l_linenumber, {PRODUCT_ID} as product_id, cast(l_quantity as bigint) as quantity, {LINE_PRICE_SQL} as price from lineitem),
n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, product_id, quantity, price nulls first) - 1 as line_no from l)
select cast(l_orderkey as varchar) as order_id, cast(line_no as integer) as line_no, product_id, quantity, price,
       p.p_partkey is not null as product_known
from n left join part p on p.p_partkey = product_id
""")
def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested orders through JSON, unnested to lines in their
    order, each line checked against the catalog."""
    lines = O.unnest(_decoded_documents(spark, sf_dir))
    return (lines.join(_catalog_ids(spark, sf_dir).withColumn("_k", F.lit(True)), "product_id", "left")
                 .select("order_id", "line_no", "product_id", "quantity", "price",
                         F.coalesce("_k", F.lit(False)).alias("product_known")))


@register("order_item_counts", """
select cast(o_orderkey as varchar) as order_id, cast(count(l_orderkey) as bigint) as n_items,
       cast(coalesce(sum(cast(l_quantity as bigint)), 0) as bigint) as total_quantity
from orders left join lineitem on l_orderkey = o_orderkey
group by o_orderkey
""")
def order_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per order (0 for orders without lines)."""
    docs = _decoded_documents(spark, sf_dir)
    qty = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["quantity"])
    return docs.select("order_id", O.item_count("items").alias("n_items"), qty.alias("total_quantity"))


#: Orders are stamped this long after the time their client claims, which is overwritten.
PAID_US = 3_000_000


@register("orders_sync", f"""
select cast(o_orderkey as varchar) as order_id, '{C.STATUS_COMPLETED}' as status,
       '{C.MSG_ORDER_SYNC}' as message, cast(count(l_orderkey) as bigint) as n_items,
       epoch_us(o_orderdate) + {PAID_US} as created_us
from orders left join lineitem on l_orderkey = o_orderkey
group by o_orderkey, o_orderdate
""")
def orders_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode, stamp processing, complete, respond."""
    docs = _decoded_documents(spark, sf_dir)
    done = O.process_sync(docs, now=F.timestamp_micros(F.unix_micros("created_at") + PAID_US))
    return O.sync_response(done.withColumn("n_items", O.item_count("items")).withColumn("created_us", F.unix_micros("created_at")), "n_items", "created_us")


@register("status_latest", """
select user_id, arg_max(event_type, event_id) as status, max(event_id) as last_seq
from events group by user_id
""")
def status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current status per key from lifecycle events (events by user)."""
    ev = tables.load(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return O.latest_status(ev, "user_id", "event_type", "event_id")


@register("dedupe_orders", """
select user_id, props, min(event_id) as first_seq, cast(count(*) as bigint) as deliveries
from events group by user_id, props
""")
def dedupe_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 (batch): a repeated (user, payload) message is one order delivered
    several times; keep the first delivery and count redeliveries."""
    ev = tables.load(spark, sf_dir, "events").select("user_id", "props", "event_id")
    return O.first_delivery(ev, ["user_id", "props"], "event_id")


# Queue messages from events, whole or damaged in one of six ways, written in
# SQL that Spark and DuckDB read alike; k is event_id modulo 11.
MESSAGES = [
    (1, "props || '}'"), (2, "substr(props, 1, length(props) - 1)"), (3, "replace(props, '\"', chr(39))"),
    (4, "'{\"items\":[{\"price\":NaN}]}'"), (5, "'{\"customer_id\":\"' || event_type || '\"}'"), (6, "props || ' x'"),
    (7, "'{\"created_at\":\"2024-01-01T00:00:00.123456789Z\",\"customer_id\":' || cast(user_id as varchar) || '}'"),
    (8, "'{\"items\":[null,{\"product_id\":' || cast(user_id as varchar) || '}]}'"), (9, "' null '"), (10, "'[' || props || ']'"),
]
MESSAGE_SQL = "case event_id % 11 " + " ".join(f"when {k} then {m}" for k, m in MESSAGES) + " else props end"


@register("poison_split", f"""
with m as (select event_id, {MESSAGE_SQL} as msg from events),
v as (select event_id, msg, json_valid(msg) and not regexp_matches(msg, ':NaN') as valid from m)
select event_id,
       not (valid and (trim(msg) = 'null' or json_type(case when valid then msg end) = 'OBJECT')
            and coalesce(json_type(case when valid then msg end, '$.customer_id') in ('BIGINT', 'UBIGINT'), true)) as poison,
       case when valid and json_type(case when valid then msg end) = 'OBJECT'
                 and json_type(case when valid then msg end, '$.customer_id') in ('BIGINT', 'UBIGINT')
            then nullif(cast(json_extract_string(case when valid then msg end, '$.customer_id') as bigint), 0) end as customer_id,
       cast(case when valid and json_type(case when valid then msg end, '$.items') = 'ARRAY'
                 then json_array_length(case when valid then msg end, '$.items') else 0 end as bigint) as n_items
from v
""")
def poison_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict decode of queue messages; the damaged ones go to the
    poison side, the others give their customer and number of items."""
    ev = tables.load(spark, sf_dir, "events")
    msg = F.expr(MESSAGE_SQL.replace("varchar", "string"))
    rows = codec.decode_rows(ev.select("event_id", msg.alias("msg")), "msg", "order", strict=True)
    customer = F.col("value.customer_id")
    return rows.select("event_id", (~F.col("ok")).alias("poison"), F.when(customer != 0, customer).alias("customer_id"),
                       O.item_count("value.items").alias("n_items"))


def _synth_orders_sql() -> str:
    k = "o_orderkey"
    n = draw_sql(k, synth.SALT_ITEMS, C.ORDER_ITEMS_MIN, C.ORDER_ITEMS_MAX)
    cust = draw_sql(k, synth.SALT_CUSTOMER, C.ORDER_CUSTOMER_MIN, C.ORDER_CUSTOMER_MAX)
    return f"""
so as (select o_orderkey as order_key, {cust} as customer_id, unnest(range(1, {n} + 1)) as i from orders),
sl as (
  select order_key, customer_id, cast(i - 1 as integer) as line_no,
    {draw_sql('order_key', '(i * 3 + 20)', C.ORDER_PRODUCT_MIN, C.ORDER_PRODUCT_MAX)} as product_id,
    {draw_sql('order_key', '(i * 3 + 21)', C.ORDER_QTY_MIN, C.ORDER_QTY_MAX)} as quantity,
    {draw_sql('order_key', '(i * 3 + 22)', C.ORDER_PRICE_CENTS_MIN, C.ORDER_PRICE_CENTS_MAX)} / 100.0 as price
  from so)"""


def _synth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = tables.load(spark, sf_dir, "orders").select("o_orderkey")
    so = synth.orders(keys, "o_orderkey")
    return O.unnest(so, ["order_key", "customer_id"])


@register("synthetic_orders", f"""
with {_synth_orders_sql()}
select order_key, customer_id, line_no, product_id, quantity, cast(price as double) as price from sl
""")
def synthetic_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic order per order key, unnested to lines."""
    return _synth_lines(spark, sf_dir).select(
        "order_key", "customer_id", F.col("line_no").cast("int").alias("line_no"),
        "product_id", "quantity", "price")


@register("order_refs_missing", f"""
select l_orderkey as order_key, l_linenumber as line_no, {PRODUCT_ID} as product_id from lineitem
where not exists (select 1 from part where p_partkey = {PRODUCT_ID})
""")
def order_refs_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose product is not in the catalog."""
    lines = tables.load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"), F.expr(PRODUCT_ID).alias("product_id"))
    return lines.join(_catalog_ids(spark, sf_dir), "product_id", "left_anti").select("order_key", "line_no", "product_id")


def _terms_sql() -> str:
    vals = ", ".join(f"({i}, '{t}')" for i, t in enumerate(C.LOAD_SEARCH_TERMS))
    return f"(select * from (values {vals}) as t(idx, q))"


@register("synthetic_search", f"""
with {__import__('storeflow.plans.search_plans', fromlist=['PROD_SQL']).PROD_SQL},
req as (select event_id as query_id,
               {draw_sql('event_id', synth.SALT_TERM, 0, len(C.LOAD_SEARCH_TERMS) - 1)} as idx
        from events),
rq as (select r.query_id, t.q from req r join {_terms_sql()} t on t.idx = r.idx),
tot as (
  select rq.query_id, rq.q, count(p.product_id) as n
  from rq left join prod p on p.product_id between 1 and {C.DEFAULT_MAX_CHECK}
    and (contains(lower(p.name), lower(rq.q)) or contains(lower(p.category), lower(rq.q)))
  group by rq.query_id, rq.q)
select query_id, q, cast(n as bigint) as total_found,
       cast(least(n, {C.DEFAULT_MAX_RESULTS}) as bigint) as returned from tot
""")
def synthetic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search request per event, answered once per distinct term."""
    products = catalog.from_part(tables.load(spark, sf_dir, "part"))
    reqs = synth.search_requests(tables.load(spark, sf_dir, "events").select("event_id"), "event_id")
    res = SR.search(products, reqs)
    return res.select("query_id", "q", "total_found",
                      F.size("products").cast("bigint").alias("returned"))


def _traffic_sql() -> str:
    total = sum(w for _, w in C.TRAFFIC_WEIGHTS)
    b = draw_sql("event_id", synth.SALT_KIND, 0, total - 1)
    kind = "case " + " ".join(f"when b between {lo} and {hi} then '{n}'"
                              for n, lo, hi in synth.traffic_kinds()) + " end"
    bad = "[" + ", ".join(f"'{v}'" for v in C.TRAFFIC_INVALID_IDS) + "]"
    return f"""
tr as (select event_id as request_id, {kind} as kind,
              {draw_sql('event_id', synth.SALT_ID, C.ORDER_PRODUCT_MIN, C.ORDER_PRODUCT_MAX)} as get_id,
              {bad}[{draw_sql('event_id', synth.SALT_ID, 0, len(C.TRAFFIC_INVALID_IDS) - 1)} + 1] as bad_id
       from (select event_id, {b} as b from events))"""


@register("synthetic_traffic", f"""
with {_traffic_sql()}
select request_id, kind,
  cast(case kind when 'get' then (case when exists (select 1 from part where p_partkey = get_id) then 200 else 404 end)
                 when 'missing' then 404 else 400 end as integer) as status_code,
  case kind when 'get' then (case when exists (select 1 from part where p_partkey = get_id) then null else 'NOT_FOUND' end)
            when 'missing' then 'NOT_FOUND' else 'INVALID_INPUT' end as error_code,
  case kind when 'add' then '{C.MSG_NAME}' end as rule
from tr where kind <> 'health'
""")
def synthetic_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted product traffic per event against the catalog.
    The load test's POST bodies have no name, so they fail validation."""
    products = catalog.from_part(tables.load(spark, sf_dir, "part"))
    reqs = synth.product_traffic(tables.load(spark, sf_dir, "events").select("event_id"), "event_id")
    out = RQ.outcomes(reqs, products)
    rule = F.when(F.col("kind") == "add", F.col("error.details"))
    return out.select("request_id", "kind", "status_code", F.col("error.error").alias("error_code"),
                      rule.alias("rule"))


@register("orders_retained", f"""
select o_orderkey, o_custkey, o_orderdate from orders
where o_orderdate >= (select max(o_orderdate) from orders) - interval {C.RETENTION_SECONDS} seconds
""")
def orders_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders still inside the 4-day retention at the newest order time."""
    o = tables.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    as_of = o.agg(F.max("o_orderdate").cast("string")).first()[0]   # one scalar
    # a wall-clock (NTZ) literal: independent of the session zone, and a
    # plain column-vs-literal predicate that reaches the parquet scan
    return O.retained(o, "o_orderdate", F.lit(as_of).cast("timestamp_ntz"))


@register("order_lines_outer", f"""
select cast(o_orderkey as varchar) as order_id, {PRODUCT_ID} as product_id,
       cast(l_quantity as bigint) as quantity
from orders left join lineitem on l_orderkey = o_orderkey
""")
def order_lines_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13 (outer): every order's lines; an order without items keeps one
    row with NULL item columns."""
    lines = O.unnest(_decoded_documents(spark, sf_dir), outer=True)
    return lines.select("order_id", "product_id", "quantity")
