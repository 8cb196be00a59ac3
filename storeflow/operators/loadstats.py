"""Request-log analytics: statistics, percentiles, throughput, latency guard,
response-contract checks and run comparison (A5-A7, F8, F13-F15, J7, P11).

``request_log``: method, name, status_code, response_body, elapsed_ms, ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..session import materialize
from .ordering import running_sum


def pct_name(p: float) -> str:
    return "p" + (f"{p * 100:g}").replace(".", "_")


def exact_percentiles(df: DataFrame, by: list[str], value: str,
                      percentiles: list[float]) -> DataFrame:
    """Exact percentiles (linear interpolation between closest ranks) per
    group.

    Rows are counted per (group, value) first, so equal values are one row
    and every sort key is unique; counts get their prefix sums over
    range-sorted blocks (a group of any size is cut into balanced blocks).
    A value's rows hold the ranks from its prefix on; the values at the two
    ranks around each target position are picked and interpolated.
    Returns ``by`` + one ``array<double>`` column ``percentiles``.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).cast("bigint").alias("_c"))
    upto = materialize(running_sum(counts, by, ["_v"], "_c", "_upto"), "value-counts")
    sizes = upto.groupBy(*by).agg(F.max("_upto").alias("_n"))
    pos = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(percentiles)])
    targets = (sizes.select(*by, F.col("_n"), F.inline(pos))
                    .withColumn("_h", (F.col("_n") - 1).cast("double") * F.col("p"))
                    .withColumn("_lo", F.floor("_h").cast("bigint"))
                    .withColumn("_hi", F.ceil("_h").cast("bigint"))
                    .groupBy(*by).agg(F.collect_list(F.struct("i", "_h", "_lo", "_hi")).alias("_t")))
    # of each value, the targets that fall on one of its ranks
    first = F.col("_upto") - F.col("_c")
    here = F.filter("_t", lambda t: ((t["_lo"] >= first) & (t["_lo"] < F.col("_upto")))
                    | ((t["_hi"] >= first) & (t["_hi"] < F.col("_upto"))))
    picked = upto.join(targets, by).select(*by, "_v", F.inline(here))
    # the lower rank's value is the least picked, the upper rank's the greatest
    per = picked.groupBy(*by, "i", "_h", "_lo").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    interp = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.col("_lo"))
    return (per.groupBy(*by)
               .agg(F.sort_array(F.collect_list(F.struct("i", interp.alias("x")))).alias("_xs"))
               .select(*by, F.transform("_xs", lambda e: e["x"]).alias("percentiles")))


def request_stats(log: DataFrame, by: list[str], *, exact: bool = True,
                  accuracy: int = 10000, percentiles: list[float] = C.PERCENTILES) -> DataFrame:
    """A5 A6 A7 per group: count, failures, avg/min/max/median, percentiles,
    requests per second over the group's time span and success rate.

    ``exact`` ranks value counts with ``exact_percentiles``;
    ``exact=False`` uses ``percentile_approx`` (one pass, bounded memory)."""
    x = F.col("elapsed_ms")
    fails = F.count_if(F.col("status_code") >= 400)
    n = F.count(F.lit(1))
    t = S.epoch_us(log, "ts")
    span_s = (F.max(t) - F.min(t)) / F.lit(1e6)
    aggs = [n.cast("bigint").alias("requests"), fails.cast("bigint").alias("failures"),
            F.avg(x).alias("avg_ms"), F.min(x).alias("min_ms"), F.max(x).alias("max_ms"),
            span_s.alias("span_s")]
    wanted = list(percentiles) + [0.5]
    if exact:
        agg = log.groupBy(*by).agg(*aggs).join(
            exact_percentiles(log, by, "elapsed_ms", wanted).withColumnRenamed("percentiles", "_p"), by, "left")
    else:
        agg = log.groupBy(*by).agg(
            *aggs, F.percentile_approx(x, F.array(*[F.lit(p) for p in wanted]), accuracy).alias("_p"))
    agg = agg.withColumn("median_ms", F.col("_p")[len(percentiles)])
    cols = [F.col("_p")[i].alias(pct_name(p)) for i, p in enumerate(percentiles)]
    return agg.select(
        *by, "requests", "failures", "avg_ms", "min_ms", "max_ms", "median_ms", *cols,
        F.when(F.col("span_s") > 0, F.col("requests") / F.col("span_s")).alias("rps"),
        ((F.col("requests") - F.col("failures")) / F.col("requests")).alias("success_rate"))


def slow_requests(log: DataFrame, limit_ms: float = C.LATENCY_LIMIT_MS) -> DataFrame:
    """F8: requests over the latency limit become 503 SERVICE_UNAVAILABLE."""
    slow = F.col("elapsed_ms") > F.lit(float(limit_ms))
    return log.where(slow).withColumn("status_code", F.lit(503)).withColumn(
        "error", S.error_record(C.ERR_SERVICE_UNAVAILABLE, C.MSG_SEARCH_UNAVAILABLE,
                                C.DETAILS_SEARCH_UNAVAILABLE))


def _has(body: Column, field: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(body), F.lit(field)), F.lit(False))


def check_search(status: Column, body: Column) -> Column:
    """(success, failure_reason) for a search response."""
    n = F.json_array_length(F.get_json_object(body, "$.products"))
    total = F.get_json_object(body, "$.total_found").try_cast("bigint")
    req = _has(body, "products") & _has(body, "total_found") & _has(body, "search_time")
    reason = (F.when(status != 200, F.format_string(C.FAIL_SEARCH_STATUS, status))
               .when(F.json_object_keys(body).isNull(), F.lit(C.FAIL_JSON))
               .when(~req, F.lit(C.FAIL_FIELDS))
               .when(n > C.DEFAULT_MAX_RESULTS, F.format_string(C.FAIL_TOO_MANY, n))
               .when(total < 0, F.format_string(C.FAIL_TOTAL, total)))
    return F.struct(reason.isNull().alias("success"), reason.alias("failure_reason"))


def check_order(status: Column, body: Column, *, asynchronous: bool, strict: bool = False) -> Column:
    """sync 200 + order_id + status completed; async 202 + order_id
    (strict: also message_id)."""
    parsed = F.json_object_keys(body).isNotNull()
    if asynchronous:
        need = _has(body, "order_id") & (_has(body, "message_id") if strict else F.lit(True))
        miss = C.FAIL_ORDER_MESSAGE if strict else C.FAIL_ORDER_ID
        reason = (F.when(status != 202, F.format_string(C.FAIL_NOT_202, status))
                   .when(~parsed, F.lit(C.FAIL_JSON_RESPONSE))
                   .when(~need, F.lit(miss)))
    else:
        ok = _has(body, "order_id") & F.coalesce(
            F.get_json_object(body, "$.status") == C.STATUS_COMPLETED, F.lit(False))
        reason = (F.when(status != 200, F.format_string(C.FAIL_STATUS, status))
                   .when(~parsed, F.lit(C.FAIL_JSON_RESPONSE))
                   .when(~ok, F.lit(C.FAIL_STRUCTURE)))
    return F.struct(reason.isNull().alias("success"), reason.alias("failure_reason"))


def check_product(kind: Column, status: Column, body: Column) -> Column:
    """add -> 204; get -> 200 with product_id; missing -> 404; invalid -> 400."""
    reason = (F.when((kind == "add") & (status != 204), F.format_string(C.FAIL_STATUS, status))
               .when((kind == "get") & (status == 404), F.lit(C.FAIL_PRODUCT_MISSING))
               .when((kind == "get") & (status != 200), F.format_string(C.FAIL_STATUS, status))
               .when((kind == "get") & ~_has(body, "product_id"), F.lit(C.FAIL_PRODUCT_ID))
               .when((kind == "missing") & (status != 404), F.format_string(C.FAIL_NOT_404, status))
               .when((kind == "invalid") & (status != 400), F.format_string(C.FAIL_NOT_400, status)))
    return F.struct(reason.isNull().alias("success"), reason.alias("failure_reason"))


def compare_runs(stats: DataFrame, run_col: str, key: list[str], metrics: list[str],
                 base: str, other: str) -> DataFrame:
    """Side-by-side metrics of two runs per key, with other/base ratios."""
    p = stats.groupBy(*key).pivot(run_col, [base, other]).agg(
        *[F.first(m).alias(m) for m in metrics])
    out = p
    for m in metrics:
        b, o = F.col(f"{base}_{m}"), F.col(f"{other}_{m}")
        out = out.withColumn(f"{m}_ratio", F.when(b != 0, o / b))
    return out
