"""Search queries over the product view of ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import search as SR
from ..sources import catalog, tables
from .registry import register, sql_values

# Queries: every distinct word of product names and categories (derived from
# the table, so the set follows the data), the load test's terms, and the
# literal-character probes '%' and '_'.
EXTRA_TERMS = sorted(set(C.LOAD_SEARCH_TERMS)) + ["%", "_"]


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.from_part(tables.load(spark, sf_dir, "part"))


def _terms(spark: SparkSession, products: DataFrame) -> DataFrame:
    extra = spark.createDataFrame([(t,) for t in EXTRA_TERMS], "q string")
    return SR.search_terms(products).unionByName(extra).distinct()


def _requests(spark: SparkSession, products: DataFrame) -> DataFrame:
    return _terms(spark, products).select(
        F.xxhash64("q").alias("query_id"), "q",
        F.lit(C.DEFAULT_MAX_CHECK).alias("max_check"),
        F.lit(C.DEFAULT_MAX_RESULTS).alias("max_results"))


TERMS_SQL = f"""
terms as (
  select distinct q from (
    select unnest(string_split(lower(p_name) || ' ' || lower(p_type), ' ')) as q from part
    union all select q from {sql_values(EXTRA_TERMS)}
  ) where q <> ''
)"""

PROD_SQL = f"prod as ({catalog.PART_PRODUCT_SQL})"

MATCH_SQL = "(contains(lower(p.name), lower(t.q)) or contains(lower(p.category), lower(t.q)))"


@register("search_bounded", f"""
with {TERMS_SQL}, {PROD_SQL},
hits as (
  select t.q, p.product_id, p.name, p.category,
         row_number() over (partition by t.q order by p.product_id) as rank
  from terms t join prod p
    on p.product_id between 1 and {C.DEFAULT_MAX_CHECK} and {MATCH_SQL}
)
select q, cast(rank as bigint) as rank, product_id, name, category
from hits where rank <= {C.DEFAULT_MAX_RESULTS}
""")
def search_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term probes ids 1..100, keeps the first 20 hits."""
    products = _products(spark, sf_dir)
    res = SR.search(products, _requests(spark, products))
    return (res.select("q", F.posexplode("products").alias("i", "p"))
               .select("q", (F.col("i") + 1).cast("bigint").alias("rank"),
                       F.col("p.product_id").alias("product_id"),
                       F.col("p.name").alias("name"), F.col("p.category").alias("category")))


@register("search_bounded_totals", f"""
with {TERMS_SQL}, {PROD_SQL}
select t.q, cast(count(p.product_id) as bigint) as total_found,
       cast(least(count(p.product_id), {C.DEFAULT_MAX_RESULTS}) as bigint) as returned,
       cast({C.DEFAULT_MAX_CHECK} as bigint) as checked
from terms t left join prod p
  on p.product_id between 1 and {C.DEFAULT_MAX_CHECK} and {MATCH_SQL}
group by t.q
""")
def search_bounded_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 L3: total_found (uncapped), returned (capped) and checked per term."""
    products = _products(spark, sf_dir)
    res = SR.search(products, _requests(spark, products))
    return res.select("q", "total_found", F.size("products").cast("bigint").alias("returned"),
                      "checked")


@register("search_totals", f"""
with {TERMS_SQL}, {PROD_SQL}
select t.q, cast(count(p.product_id) as bigint) as total_found
from terms t left join prod p on {MATCH_SQL}
group by t.q
""")
def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 A3 over the whole catalog: matches per term, zero-hit terms kept."""
    products = _products(spark, sf_dir)
    keys = _terms(spark, products).select(
        "q", F.lower("q").alias("q_lower"), F.lit(0).alias("max_check"),
        F.lit(C.DEFAULT_MAX_RESULTS).alias("max_results"))
    hits = SR.match_positions(products, keys.select(*SR.KEY), bounded=False)
    tot = SR.totals(hits, keys)
    return keys.join(tot, SR.KEY, "left").select("q", "total_found")


@register("search_topn", f"""
with {TERMS_SQL}, {PROD_SQL},
hits as (
  select t.q, p.product_id,
         row_number() over (partition by t.q order by p.product_id) as rank
  from terms t join prod p on {MATCH_SQL}
)
select q, cast(rank as bigint) as rank, product_id from hits where rank <= {C.DEFAULT_MAX_RESULTS}
""")
def search_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 W2 over the whole catalog: first 20 hits per term in id order."""
    products = _products(spark, sf_dir)
    keys = _terms(spark, products).select(
        "q", F.lower("q").alias("q_lower"), F.lit(0).alias("max_check"),
        F.lit(C.DEFAULT_MAX_RESULTS).alias("max_results"))
    hits = SR.match_positions(products, keys.select(*SR.KEY), bounded=False)
    top = SR.top_matches(hits, C.DEFAULT_MAX_RESULTS)
    return keys.join(top, SR.KEY).select("q", "rank", "product_id")


@register("search_response", f"""
with {TERMS_SQL}, {PROD_SQL},
hits as (
  select t.q, p.*, row_number() over (partition by t.q order by p.product_id) as rank
  from terms t join prod p
    on p.product_id between 1 and {C.DEFAULT_MAX_CHECK} and {MATCH_SQL}
),
agg as (
  select q, cast(count(*) as bigint) as total_found,
         list({{'product_id': product_id, 'sku': sku, 'manufacturer': manufacturer,
               'category_id': category_id, 'weight': weight, 'some_other_id': some_other_id,
               'name': name, 'category': category, 'description': description,
               'brand': brand}} order by rank) filter (where rank <= {C.DEFAULT_MAX_RESULTS}) as products
  from hits group by q
)
select t.q, 200 as status_code,
       cast(to_json({{'products': coalesce(a.products, []),
                      'total_found': coalesce(a.total_found, 0)}}) as varchar) as body
from terms t left join agg a on a.q = t.q
""")
def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON response body of each bounded search."""
    products = _products(spark, sf_dir)
    res = SR.search(products, _requests(spark, products))
    return SR.response_json(res).select("q", "status_code", "body")


#: A small wrap, so that probes beyond it come up in small catalogs too.
WRAP = 40
# One request per event: the word of a part's name, with limits of all kinds
# (absent, zero, negative, below and beyond the wrap), no word in every
# eleventh, and the event's value as the measured time.
REQUEST_FIELDS = {
    "q": "case when event_id % 11 = 0 then '' else word end",
    "max_check": "case event_id % 6 when 0 then 0 when 1 then -3 when 2 then 25 when 3 then 60 when 4 then 150 end",
    "max_results": "case event_id % 5 when 0 then -1 when 1 then 3 when 2 then 7 when 3 then 0 else 50 end",
    "elapsed_ms": "value * 10",
}


def mixed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tables.load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("user_id"), F.element_at(F.split("p_name", " "), -1).alias("word"))
    ev = tables.load(spark, sf_dir, "events").join(words, "user_id")
    return ev.select(F.col("event_id").alias("query_id"), *[F.expr(x).alias(c) for c, x in REQUEST_FIELDS.items()])


MIXED_SQL = f"""
{PROD_SQL},
words as (select p_partkey as user_id, list_last(string_split(p_name, ' ')) as word from part),
req as (select event_id as query_id, {', '.join(f'{x} as {c}' for c, x in REQUEST_FIELDS.items())} from events join words using (user_id)),
norm as (select query_id, q, elapsed_ms, case when max_check > 0 then max_check else {C.DEFAULT_MAX_CHECK} end as mc,
                case when max_results > 0 then max_results else {C.DEFAULT_MAX_RESULTS} end as mr from req),
keys as (select distinct q, mc, mr from norm where q <> ''),
hits as (
  select k.q, k.mc, k.mr, p.product_id, p.product_id - 1 as pos from keys k join prod p on p.product_id between 1 and least({WRAP}, k.mc)
    and (contains(lower(p.name), lower(k.q)) or contains(lower(p.category), lower(k.q)))
  union all
  select k.q, k.mc, k.mr, p.product_id, p.product_id - 1 + {WRAP} from keys k join prod p on p.product_id between 1 and k.mc - {WRAP}
    and (contains(lower(p.name), lower(k.q)) or contains(lower(p.category), lower(k.q)))),
ranked as (select *, row_number() over (partition by q, mc, mr order by pos) as rank from hits),
agg as (select q, mc, mr, count(*) as n, sum(case when rank <= mr then product_id end) as ids, count(case when rank <= mr then 1 end) as returned
        from ranked group by q, mc, mr),
answers as (
  select query_id, norm.q, case when norm.q = '' then 400 when elapsed_ms > {C.LATENCY_LIMIT_MS} then 503 else 200 end as status_code,
         elapsed_ms, norm.mc, coalesce(n, 0) as n, coalesce(ids, 0) as ids, coalesce(returned, 0) as returned
  from norm left join agg on agg.q = norm.q and agg.mc = norm.mc and agg.mr = norm.mr)"""


@register("search_mixed", f"""
with {MIXED_SQL}
select query_id, q, status_code, case when status_code = 200 then cast(n as bigint) end as total_found,
       case when status_code = 200 then cast(mc as bigint) end as checked,
       cast(case when status_code = 200 then returned else 0 end as bigint) as returned,
       cast(case when status_code = 200 then ids else 0 end as bigint) as id_sum,
       case when status_code = 200 then elapsed_ms end as search_time_ms
from answers
""")
def search_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all kinds, with wrap and measured time."""
    products = _products(spark, sf_dir)
    res = SR.search(products, mixed_requests(spark, sf_dir), wrap=WRAP)
    ids = F.aggregate("products", F.lit(0).cast("bigint"), lambda a, x: a + x["product_id"])
    return res.select("query_id", "q", "status_code", "total_found", "checked", F.size("products").cast("bigint").alias("returned"),
                      ids.alias("id_sum"), "search_time_ms")
