"""Mergeable latency sketches: rank error, merging, groups without values."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from storeflow import constants as C
from storeflow.operators import loadstats as LS
from storeflow.operators import sketches as SK

T0 = datetime.datetime(2025, 10, 25)


def log(spark, rows):
    return spark.createDataFrame([("GET", n, s, x, T0 + datetime.timedelta(hours=h)) for n, s, x, h in rows],
                                 "method string, name string, status_code int, elapsed_ms double, ts timestamp_ntz")


@pytest.mark.parametrize("shape", ["uniform", "ties", "heavy"])
def test_rank_error(spark, shape):
    rng = random.Random(shape)
    draw = {"uniform": rng.random, "ties": lambda: float(rng.randrange(7)), "heavy": lambda: rng.paretovariate(0.5)}[shape]
    df = log(spark, [("a", 200, draw(), k % 200) for k in range(20000)])
    st = SK.statistics(SK.daily(df, ["name"]), ["name"])
    gaps = SK.rank_gap(df, ["name"], st, "elapsed_ms", {LS.pct_name(p): p for p in C.PERCENTILES}).first()
    assert max(gaps[LS.pct_name(p)] for p in C.PERCENTILES) <= SK.RANK_ERROR
    exact = df.agg(F.min("elapsed_ms"), F.max("elapsed_ms")).first()
    r = st.first()
    assert (r.min_ms, r.max_ms, r.requests, r.valued) == (*exact, 20000, 20000)


def test_rank_gap_sees_a_wrong_percentile(spark):
    df = log(spark, [("a", 200, float(k), 0) for k in range(100)])
    told = spark.createDataFrame([("a", 49.0, 90.0)], "name string, p50 double, p75 double")
    gaps = SK.rank_gap(df, ["name"], told, "elapsed_ms", {"p50": 0.5, "p75": 0.75}).first()
    assert gaps.p50 == 0 and abs(gaps.p75 - 0.15) < 1e-9


def test_merging_days_and_logs(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([200, 500]), rng.random() * 100, k % 96) for k in range(5000)]
    df = log(spark, rows)
    day = SK.daily(df, ["name"])
    assert day.count() == 8
    whole = {r.name: r for r in SK.statistics(day, ["name"], [0.5]).collect()}
    # a log told in two parts gives the same counts and ends
    half = SK.daily(df.where("ts < '2025-10-26'"), ["name"]).unionByName(SK.daily(df.where("ts >= '2025-10-26'"), ["name"]))
    for r in SK.statistics(half, ["name"], [0.5]).collect():
        w = whole[r.name]
        assert (r.requests, r.failures, r.valued, r.min_ms, r.max_ms) == (w.requests, w.failures, w.valued, w.min_ms, w.max_ms)
        assert r.requests == sum(x[0] == r.name for x in rows) and r.failures == sum(x[0] == r.name and x[1] == 500 for x in rows)


def test_missing_values_and_empty_logs(spark):
    nan = float("nan")
    df = log(spark, [("a", 200, None, 0), ("a", 200, 5.0, 30), ("b", 200, None, 0), ("b", 500, nan, 1), (None, 200, 1.0, 0)])
    got = {r.name: (r.requests, r.valued, r.min_ms, r.median_ms, r.p99) for r in SK.statistics(SK.daily(df, ["name"]), ["name"]).collect()}
    assert got == {"a": (2, 1, 5.0, 5.0, 5.0), "b": (2, 0, None, None, None), None: (1, 1, 1.0, 1.0, 1.0)}
    assert SK.statistics(SK.daily(df.limit(0), ["name"]), ["name"]).collect() == []


def test_compare_runs_from_sketches(spark):
    rows = [("a", 200, float(k), k % 24) for k in range(100)] + [("a", 200, 2.0 * k, 48 + k % 24) for k in range(50)] + [("b", 200, 1.0, 0)]
    df = log(spark, rows).withColumn("run", F.when(F.col("ts") < F.lit("2025-10-27").cast("timestamp_ntz"), "x").otherwise("y"))
    got = {r.name: r for r in SK.compare(SK.daily(df, ["run", "name"]), "run", ["name"], "x", "y").collect()}
    assert (got["a"].x_requests, got["a"].y_requests, got["a"].requests_ratio, got["a"].y_max_ms) == (100, 50, 0.5, 98.0)
    assert got["b"].y_requests is None and got["b"].requests_ratio is None
