"""Response-contract checks (F13-F15) over responses that the operators
themselves produce from the driver tables, with their own status codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import loadstats as LS
from ..operators import orders as O
from ..operators import requests as RQ
from ..operators import search as SR
from ..sources import catalog, tables
from . import keyed_plans, order_plans, search_plans, streaming_plans
from .registry import ORACLE_SQL, register


def _summary(df: DataFrame, result) -> DataFrame:
    """Responses per verdict."""
    return df.select(result.alias("r")).groupBy(
        F.col("r.success").alias("success"), F.col("r.failure_reason").alias("failure_reason")
    ).agg(F.count(F.lit(1)).cast("bigint").alias("responses"))


def _summary_sql(reason: str, source: str) -> str:
    return (f"select r is null as success, r as failure_reason, cast(count(*) as bigint) as responses "
            f"from (select {reason} as r from {source}) group by 1, 2")


@register("contract_search", f"""
with {search_plans.MIXED_SQL}
{_summary_sql("case when status_code <> 200 then 'Search failed with status ' || status_code "
              "when returned > 20 then 'Too many products returned: ' || returned end", "answers")}
""")
def contract_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13 over the answers to mixed search requests."""
    products = catalog.from_part(tables.load(spark, sf_dir, "part"))
    res = SR.response_json(SR.search(products, search_plans.mixed_requests(spark, sf_dir), wrap=search_plans.WRAP))
    return _summary(res, LS.check_search(F.col("status_code"), F.col("body")))


# Sync order bodies: order documents, every ninth with a customer of the wrong
# type (400).
@register("contract_orders_sync", f"""
{_summary_sql("case when o_orderkey % 9 = 4 then 'Got status code 400' end", "orders")}
""")
def contract_orders_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14 (sync) over the responses of the synchronous path."""
    bodies = order_plans.order_bodies(spark, sf_dir)
    number = F.col("order_id").cast("bigint")
    bad = F.regexp_replace("body", '"customer_id":([0-9]+)', '"customer_id":"$1"')
    sent = bodies.withColumn("body", F.when(number % 9 == 4, bad).otherwise(F.col("body")))
    answers = O.sync_answers(sent, now=F.lit("2024-01-01").cast("timestamp"))
    return _summary(answers, LS.check_order(F.col("status_code"), F.col("response_body"), asynchronous=False))


@register("contract_orders_async", f"""
with {streaming_plans.REQUESTS_SQL}
{_summary_sql("case when bad then 'Expected 202, got 400' when large then 'Expected 202, got 500' end", "req")}
""")
def contract_orders_async(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14 (async, strict) over the answers to order requests."""
    rows = streaming_plans.judge_requests(streaming_plans.order_requests(tables.load(spark, sf_dir, "events")))
    acc = F.to_json(F.struct(F.lit(C.MSG_ORDER_ASYNC).alias("message"), "order_id", F.lit(C.STATUS_PENDING).alias("status"), "message_id"))
    body = F.when(F.col("status_code") == 202, acc).otherwise(F.to_json(F.struct("error")))
    return _summary(rows, LS.check_order(F.col("status_code"), body, asynchronous=True, strict=True))


@register("contract_checks", f"""
with looked as ({ORACLE_SQL["lookup_status"]}),
wrote as ({ORACLE_SQL["product_writes"]}),
answers as (
  select case source when 'line' then 'get' when 'order' then 'missing' else 'invalid' end as kind, status_code from looked
  union all select 'add', status_code from wrote)
{_summary_sql("case when kind = 'add' and status_code <> 204 then 'Got status code ' || status_code "
              "when kind = 'get' and status_code = 404 then 'Product not found' "
              "when kind = 'get' and status_code <> 200 then 'Got status code ' || status_code end", "answers")}
""")
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15 over the answers to the tables' own product traffic: lines ask for
    their part, orders for ids that are missing, documents by tags that are no
    ids, and every kind of write."""
    products = catalog.from_part(tables.load(spark, sf_dir, "part"))
    kind = F.when(F.col("source") == "line", "get").when(F.col("source") == "order", "missing").when(F.col("source") == "doc", "invalid")
    looked = RQ.outcomes(keyed_plans._get_requests(spark, sf_dir), products).withColumn("kind", kind)
    wrote = RQ.outcomes(keyed_plans._post_requests(spark, sf_dir), products).withColumn("kind", F.lit("add"))
    answers = looked.select("kind", "status_code", "response_body", "error").unionByName(wrote.select("kind", "status_code", "response_body", "error"))
    body = F.coalesce(F.col("response_body"), F.to_json(F.col("error")))
    return _summary(answers, LS.check_product(F.col("kind"), F.col("status_code"), body))
