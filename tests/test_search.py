import random

import pytest
from pyspark.sql import functions as F

from storeflow.operators import search as SR
from storeflow.schemas import PRODUCT
from storeflow.sources import catalog

FIVE = [
    (1, "iPhone 15", "Electronics", "Apple"),
    (2, "MacBook Pro", "Electronics", "Apple"),
    (3, "Harry Potter", "Books", "Scholastic"),
    (4, "Learning Go", "Books", "OReilly"),
    (5, "Coffee Table", "Home", "IKEA"),
]


def five(spark):
    rows = [(i, f"SKU-{i}", b, 1, 100, i, n, c, "", b) for i, n, c, b in FIVE]
    return spark.createDataFrame(rows, PRODUCT)


def run(spark, products, reqs, **kw):
    df = spark.createDataFrame(reqs, "query_id bigint, q string, max_check int, max_results int")
    return {r.query_id: r for r in SR.search(products, df, **kw).collect()}



def test_five_product_goldens(spark):
    res = run(spark, five(spark), [(1, "iPhone", 10, 5), (2, "Electronics", 10, 5), (3, "books", 10, 5),
                                   (4, "Electronics", 10, 1), (5, "Apple", 10, 5), (6, "", 10, 5)])
    assert (len(res[1].products), res[1].total_found) == (1, 1)
    assert (len(res[2].products), res[2].total_found) == (2, 2)
    assert (len(res[3].products), res[3].total_found) == (2, 2)
    assert (len(res[4].products), res[4].total_found) == (1, 2)
    assert (len(res[5].products), res[5].total_found) == (0, 0)   # brand is not searched
    assert res[6].status_code == 400 and res[6].error.error == "INVALID_INPUT"


def test_empty_query_matches_everything_at_operator_level(spark):
    keys = spark.createDataFrame([("", 10, 5)], "q_lower string, max_check int, max_results int")
    hits = SR.match_positions(five(spark), keys)
    assert hits.count() == 5


GENERATED = [  # q, total_found, returned, first ids
    ("Alpha", 10, 10, [1, 11, 21]), ("ALPHA", 10, 10, [1, 11, 21]), ("beta", 10, 10, [2, 12, 22]),
    ("Eta", 40, 20, [2, 6, 7]), ("electronics", 13, 13, [1, 9, 17]), ("Book", 13, 13, [2, 10, 18]),
    ("Home", 13, 13, [3, 11, 19]), ("SPORTS", 13, 13, [4, 12, 20]), ("Clothing", 12, 12, [5, 13, 21]),
    ("Beauty", 12, 12, [6, 14, 22]), ("Toys", 12, 12, [7, 15, 23]), ("Automotive", 12, 12, [8, 16, 24]),
    ("Product", 100, 20, [1, 2, 3]), ("%", 0, 0, []), ("_", 0, 0, []), ("999", 0, 0, []),
]



def test_generated_catalog_goldens(spark):
    cat = catalog.generate(spark)
    res = run(spark, cat, [(i, q, 100, 20) for i, (q, *_) in enumerate(GENERATED)])
    for i, (q, total, returned, first) in enumerate(GENERATED):
        r = res[i]
        assert r.total_found == total, q
        assert len(r.products) == returned, q
        assert [p.product_id for p in r.products][:3] == first, q
        assert r.checked == 100
    last = [p.product_id for p in res[3].products]
    assert last[-1] == 48


def test_repeated_ids_count_by_row(spark):
    rows = [(1, "a", "m", 1, 1, 1, "red rod", "Home", "", "x"), (1, "b", "m", 1, 1, 1, "a red", "Home", "", "x"),
            (1, "b", "m", 1, 1, 1, "a red", "Home", "", "x"), (2, "c", "m", 1, 1, 1, "blue", "Toys", "", "x")]
    res = run(spark, spark.createDataFrame(rows, PRODUCT), [(1, "red", 10, 5), (2, "e", 10, 2), (3, "zzz", 10, 5)])
    assert res[1].total_found == 3 and sorted(p.sku for p in res[1].products) == ["a", "b", "b"]
    assert res[2].total_found == 4 and len(res[2].products) == 2
    assert res[3].total_found == 0 and res[3].products == []


def test_measured_time_and_latency_guard(spark):
    reqs = spark.createDataFrame([(1, "iphone", 10, 5, 1.5), (2, "iphone", 10, 5, 2000.0), (3, "iphone", 10, 5, 2000.1), (4, "", 10, 5, 1.0)],
                                 "query_id bigint, q string, max_check int, max_results int, elapsed_ms double")
    res = {r.query_id: r for r in SR.response_json(SR.search(five(spark), reqs)).collect()}
    assert [res[i].status_code for i in (1, 2, 3, 4)] == [200, 200, 503, 400]
    assert res[1].body.endswith('"total_found":1,"search_time":"1.5ms"}') and '"search_time":"2s"' in res[2].body
    assert res[3].error.error == "SERVICE_UNAVAILABLE" and res[3].total_found is None


def brute(products, q, max_check, max_results, wrap):
    by_id = {p[0]: p for p in products}
    hits = []
    for i in range(max_check):
        pid = 1 + i
        if pid > wrap:
            pid -= wrap
        p = by_id.get(pid)
        if p and (q.lower() in p[6].lower() or q.lower() in p[7].lower()):
            hits.append(pid)
    return len(hits), hits[:max_results]



def test_wrap_against_brute_force(spark):
    rnd = random.Random(7)
    words = ["red", "blue", "Gear", "rod", "ab", "b"]
    rows = [(i, f"SKU-{i}", "m", 1, 1, i, f"{rnd.choice(words)} {rnd.choice(words)}",
             rnd.choice(["Toys", "Home"]), "", "x") for i in range(1, 31) if i % 7]
    rows += [(i, f"SKU-{i}", "m", 1, 1, i, "red rod", "Home", "", "x") for i in (33, 34)]
    products = spark.createDataFrame(rows, PRODUCT)
    reqs = [(k, q, mc, mr) for k, (q, mc, mr) in enumerate(
        [("red", 5, 3), ("r", 25, 4), ("o", 45, 100), ("ROD", 70, 5), ("b", 12, 2), ("gear", -1, 0),
         ("e", 64, 50)])]
    res = run(spark, products, reqs, wrap=20)
    for k, q, mc, mr in reqs:
        mc2 = mc if mc > 0 else 100
        mr2 = mr if mr > 0 else 20
        total, first = brute(rows, q, mc2, mr2, 20)
        assert res[k].total_found == total, q
        assert [p.product_id for p in res[k].products] == first, q


def test_response_json(spark):
    res = SR.search(five(spark), spark.createDataFrame(
        [(1, "iphone", 10, 5)], "query_id bigint, q string, max_check int, max_results int"))
    body = SR.response_json(res).first().body
    assert body.startswith('{"products":[{"product_id":1,"sku":"SKU-1"')
    assert body.endswith('"total_found":1}')


def test_window_group_limit_planned(spark):
    keys = spark.createDataFrame([("a", 100, 20)], "q_lower string, max_check int, max_results int")
    hits = SR.match_positions(catalog.generate(spark, 1000), keys)
    plan = SR.top_matches(hits, 20)._jdf.queryExecution().executedPlan().toString()
    # the limit runs map-side (Partial) before the shuffle, then Final
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan
    assert SR.top_matches(hits, 20).count() == 20
    assert F is not None


def test_postings_shrink_candidates_of_common_grams(spark):
    """Every gram of the key is common, few products have them all: of the
    hundreds that the rarest gram alone would give, those few are read."""
    names = [f"the {i}" for i in range(300)] + [f"het {i}" for i in range(300)] + [f"eta {i}" for i in range(300)] + ["theta"] * 3 + ["eta het the"]
    rows = [(i + 1, "s", "m", 1, 1, 1, n, "Toys", "", "x") for i, n in enumerate(names)] + [(40000, "s", "m", 1, 1, 1, "a THETA", "", "", "x"), (40001, "s", "m", 1, 1, 1, "x", "thet", "", "x")]
    products = spark.createDataFrame(rows, PRODUCT)
    keys = spark.createDataFrame([("theta", 0, 20), ("zzz", 0, 20), ("", 0, 20)], "q_lower string, max_check int, max_results int")
    prod = SR._prepared_products(products, None)
    met = SR.candidate_ids(prod, keys, [0, 3])
    assert sorted(r.product_id for r in met.where("q_lower = 'theta'").collect()) == [901, 902, 903, 904, 40000]
    assert met.where("q_lower = 'zzz'").isEmpty() and met.where("q_lower = ''").count() == len(rows)
    grams = prod.select(F.explode(SR._grams(F.col("name_l"), 3)).alias("g")).groupBy("g").count()
    assert grams.where("g in ('the', 'het', 'eta')").agg(F.min("count")).first()[0] > 300
    hits = SR.match_positions(products, keys, bounded=False)
    assert sorted(r.product_id for r in hits.where("q_lower = 'theta'").collect()) == [901, 902, 903, 40000]


def test_result_lists_read_only_probed_products(spark):
    """The probe bound reaches the scan that gives the product columns, and
    only ranked rows are shuffled by all columns."""
    from storeflow.sources import tables
    products = catalog.from_part(tables.load(spark, "/root/testdata/sf0.001", "part"))
    keys = spark.createDataFrame([("ring", 50, 20)], "q_lower string, max_check int, max_results int")
    top = SR.top_matches(SR.match_positions(products, keys), 20)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = SR.result_lists(top, products, 50)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [x for x in plan.split("\n") if "FileScan parquet [p_partkey" in x]
    assert scans and all("LessThanOrEqual(p_partkey,50)" in x for x in scans)
    assert plan.index("LeftSemi") > plan.index("HashAggregate" if "HashAggregate" in plan else "SortAggregate")  # the join is below the aggregate
