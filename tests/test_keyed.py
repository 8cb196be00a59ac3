import pytest
from pyspark.sql import functions as F

from storeflow import constants as C
from storeflow.operators import keyed as K
from storeflow.operators import requests as RQ
from storeflow.sources import catalog


def test_upsert_last_write_wins_and_count(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    upd = spark.createDataFrame([(2, "b1", 1), (2, "b2", 2), (3, "c", 1), (3, "c0", 0)],
                                "id int, v string, seq int")
    out = {r.id: r.v for r in K.upsert(base, upd, "id", "seq").collect()}
    assert out == {1: "a", 2: "b2", 3: "c"}
    assert K.net_new_count(base, upd, "id").first()[0] == 1


def test_lookup_exists_missing(spark):
    cat = catalog.generate(spark, 100)
    req = spark.createDataFrame([(5,), (500,)], "product_id int")
    res = {r.product_id: r for r in K.lookup(req, cat).collect()}
    assert res[5].found and res[5].error is None
    assert not res[500].found and res[500].error.error == C.ERR_NOT_FOUND
    assert [r[0] for r in K.exists(req, cat.select("product_id"), "product_id").collect()] == [5]
    assert [r[0] for r in K.missing(req, cat.select("product_id"), "product_id").collect()] == [500]


def test_request_outcomes_order_of_checks(spark):
    cat = catalog.generate(spark, 100)
    good = ('{"product_id":7,"sku":"S","manufacturer":"M","category_id":1,"weight":0,'
            '"some_other_id":1,"name":"N","category":"C","description":"","brand":"B"}')
    reqs = [
        (1, "GET", "5", None), (2, "GET", "abc", None), (3, "GET", "900000", None),
        (4, "GET", "0", None), (5, "POST", "7", good), (6, "POST", "-1", good),
        (7, "POST", "7", "{bad"), (8, "POST", "8", good), (9, "POST", "7", good.replace('"N"', '""')),
        (10, "POST", "7", "null"), (11, "GET", "999999999999999", None),
    ]
    df = spark.createDataFrame(reqs, "request_id bigint, method string, product_id_text string, body string")
    out = {r.request_id: r for r in RQ.outcomes(df, cat).collect()}
    assert out[1].status_code == 200 and '"product_id":5' in out[1].response_body
    assert out[2].status_code == 400 and out[2].error.message == C.MSG_INVALID_ID
    assert out[3].status_code == 404
    assert out[4].status_code == 400
    assert out[5].status_code == 204 and out[5].accepted.product_id == 7
    assert out[6].status_code == 400 and out[6].error.message == C.MSG_INVALID_ID
    assert out[7].error.message == C.MSG_INVALID_JSON
    assert out[8].error.message == C.MSG_ID_MISMATCH
    assert out[9].error.message == C.MSG_INVALID_DATA and out[9].error.details == C.MSG_NAME
    assert out[10].error.message == C.MSG_ID_MISMATCH   # null body -> zero product
    assert out[11].status_code == 400
    assert F is not None


def test_upsert_writes_new_version(spark, tmp_path):
    root = str(tmp_path / "catalog")
    v1 = K.write_version(catalog.generate(spark, 10), root, 1)
    base = spark.read.parquet(v1)
    upd = catalog.generate(spark, 12).where("product_id > 8").withColumn("seq", F.lit(1))
    v2 = K.write_version(K.upsert(base, upd, "product_id", "seq"), root, 2)
    assert v1.endswith("version=1") and v2.endswith("version=2")
    assert spark.read.parquet(v1).count() == 10 and spark.read.parquet(v2).count() == 12
    with pytest.raises(Exception):
        K.write_version(base, root, 1)
