import numpy as np
from pyspark.sql import functions as F

from storeflow import constants as C
from storeflow.operators import loadstats as LS


def test_request_stats_percentiles(spark):
    vals = [float(v) for v in range(1, 101)] + [500.0]
    df = spark.createDataFrame([("POST", "/orders", 200 if v < 500 else 500, v, "2025-10-25 22:25:00")
                                for v in vals], "method string, name string, status_code int, elapsed_ms double, ts string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    r = LS.request_stats(df, ["method", "name"]).first()
    assert (r.requests, r.failures) == (101, 1)
    for p in C.PERCENTILES:
        assert abs(r[LS.pct_name(p)] - float(np.percentile(vals, p * 100))) < 1e-9
    assert r.median_ms == float(np.median(vals)) and r.rps is None
    approx = LS.request_stats(df, ["name"], exact=False).first()
    assert approx.p100 == 500.0


def test_slow_requests_guard(spark):
    df = spark.createDataFrame([(2000.0,), (2000.1,)], "elapsed_ms double")
    out = LS.slow_requests(df).collect()
    assert len(out) == 1 and out[0].status_code == 503 and out[0].error.error == C.ERR_SERVICE_UNAVAILABLE


def test_contract_checks(spark):
    search = spark.createDataFrame([
        (200, '{"products":[],"total_found":0,"search_time":"1ms"}'),
        (200, '{"products":[],"total_found":0}'),
        (200, '{"products":[' + ",".join(["{}"] * 21) + '],"total_found":21,"search_time":"1ms"}'),
        (200, '{"products":[],"total_found":-1,"search_time":"1ms"}'),
        (503, '{"error":"SERVICE_UNAVAILABLE"}'),
        (200, 'not json'),
    ], "s int, b string")
    got = [r[0] for r in search.select(LS.check_search(F.col("s"), F.col("b"))).collect()]
    assert [g.success for g in got] == [True, False, False, False, False, False]
    assert got[1].failure_reason == "Missing required fields in response"
    assert got[2].failure_reason == "Too many products returned: 21"
    assert got[4].failure_reason == "Search failed with status 503"
    orders = spark.createDataFrame([
        (200, '{"order_id":"a","status":"completed"}', False), (200, '{"order_id":"a","status":"processing"}', False),
        (202, '{"order_id":"a","message_id":"m"}', True), (202, '{"order_id":"a"}', True), (200, '{"order_id":"a"}', True),
    ], "s int, b string, a boolean")
    res = []
    for r in orders.collect():
        one = spark.createDataFrame([(r.s, r.b)], "s int, b string")
        res.append(one.select(LS.check_order(F.col("s"), F.col("b"), asynchronous=r.a, strict=True)).first()[0])
    assert [x.success for x in res] == [True, False, True, False, False]
    prods = spark.createDataFrame([("add", 204, None), ("add", 400, "{}"), ("get", 200, '{"product_id":1}'),
                                   ("get", 404, "{}"), ("missing", 404, "{}"), ("invalid", 400, "{}"),
                                   ("invalid", 200, "{}")], "k string, s int, b string")
    got = [r[0].success for r in prods.select(LS.check_product(F.col("k"), F.col("s"), F.col("b"))).collect()]
    assert got == [True, False, True, False, True, True, False]


def test_exact_percentiles_skewed_groups(spark):
    import random
    rnd = random.Random(11)
    rows = [("hot", float(rnd.randrange(0, 5000)) / 7) for _ in range(30000)]
    rows += [(f"g{k}", float(rnd.randrange(0, 100))) for k in range(40) for _ in range(rnd.randrange(1, 30))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    ps = [0.0, 0.25, 0.5, 0.66, 0.9, 0.999, 1.0]
    got = {r.k: r.percentiles for r in LS.exact_percentiles(df, ["k"], "v", ps).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    for k, vs in by.items():
        want = [float(np.percentile(vs, p * 100)) for p in ps]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], want)), k


def test_equal_values_do_not_fill_one_block(spark):
    """90 % equal values: percentiles are right and no sorted block is large."""
    from storeflow.operators import loadstats as LS
    from storeflow.operators.ordering import sorted_blocks
    df = spark.range(200_000).selectExpr("'a' as name", "case when id % 10 = 0 then cast(id as double) else 7.0 end as v")
    got = LS.exact_percentiles(df, ["name"], "v", [0.0, 0.5, 0.9, 0.95, 1.0]).first().percentiles
    values = sorted([float(i) if i % 10 == 0 else 7.0 for i in range(200_000)])
    for p, x in zip([0.0, 0.5, 0.9, 0.95, 1.0], got):
        h = (len(values) - 1) * p
        lo, hi = values[int(h)], values[min(int(h) + 1, len(values) - 1)]
        assert abs(x - (lo + (hi - lo) * (h - int(h)))) < 1e-6
    counts = df.groupBy("name", "v").count()
    sizes = [r["count"] for r in sorted_blocks(counts, ["name"], ["v"]).groupBy("_blk").count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
