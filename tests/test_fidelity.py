"""Randomized cross-checks of scalar rules against small Python models of
the service's behavior (byte lengths, ParseInt(s, 10, 32), exact JSON keys)."""

import random
import re

from pyspark.sql import functions as F

from storeflow import constants as C
from storeflow.functions import scalars as S
from storeflow.functions import validation as V
from storeflow.schemas import PRODUCT
from storeflow.sources import codec

LIMITS = [  # (field, lo, hi) in bytes; hi None = no upper bound
    ("sku", 1, 100, C.MSG_SKU), ("manufacturer", 1, 200, C.MSG_MANUFACTURER),
    ("name", 1, 200, C.MSG_NAME), ("category", 1, 100, C.MSG_CATEGORY),
    ("description", 0, 1000, C.MSG_DESCRIPTION), ("brand", 1, 100, C.MSG_BRAND),
]


def model_first_error(p):
    if p["product_id"] < 1:
        return C.MSG_PRODUCT_ID
    order = ["sku", "manufacturer", "category_id", "weight", "some_other_id", "name", "category",
             "description", "brand"]
    lim = {f: (lo, hi, m) for f, lo, hi, m in LIMITS}
    for f in order:
        if f == "category_id" and p[f] < 1:
            return C.MSG_CATEGORY_ID
        if f == "weight" and p[f] < 0:
            return C.MSG_WEIGHT
        if f == "some_other_id" and p[f] < 1:
            return C.MSG_SOME_OTHER_ID
        if f in lim:
            lo, hi, m = lim[f]
            n = len(p[f].encode("utf-8"))
            if n < lo or n > hi:
                return m
    return None


def rand_text(rnd, max_chars):
    alphabet = "abcXYZ 09-é漢😀"
    return "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, max_chars)))


def test_validation_matches_model(spark):
    rnd = random.Random(2024)
    rows = []
    for _ in range(400):
        p = {"product_id": rnd.choice([-1, 0, 1, 7]), "sku": rand_text(rnd, 60),
             "manufacturer": rand_text(rnd, 80), "category_id": rnd.choice([0, 1, 3]),
             "weight": rnd.choice([-5, 0, 10]), "some_other_id": rnd.choice([0, 2]),
             "name": rand_text(rnd, 80), "category": rand_text(rnd, 40),
             "description": rand_text(rnd, 400), "brand": rand_text(rnd, 40)}
        rows.append(p)
    df = spark.createDataFrame([tuple(p[f.name] for f in PRODUCT.fields) for p in rows], PRODUCT)
    got = [r[0] for r in df.select(V.first_error()).collect()]
    assert got == [model_first_error(p) for p in rows]
    assert sum(g is None for g in got) > 0 and len(set(got)) > 5


def model_parse_id(s):
    if s is None or not re.fullmatch(r"[+-]?[0-9]+", s):
        return False
    v = int(s)
    return -2**31 <= v <= 2**31 - 1 and v >= 1


def test_id_parsing_matches_model(spark):
    rnd = random.Random(7)
    texts = []
    for _ in range(500):
        k = rnd.randrange(6)
        if k == 0:
            texts.append(str(rnd.randrange(-10, 3_000_000_000)))
        elif k == 1:
            texts.append(rnd.choice(["+", "-", ""]) + "0" * rnd.randrange(0, 12) + str(rnd.randrange(0, 99999)))
        elif k == 2:
            texts.append(rnd.choice(["", " 5", "5 ", "1e3", "0x10", "1_000", "٣", "12a", "+", "-"]))
        elif k == 3:
            texts.append(str(rnd.choice([2**31 - 1, 2**31, -2**31, 2**63, 999999999999999])))
        else:
            texts.append(str(rnd.randrange(1, 100000)))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(S.valid_id(S.parse_request_id("t"))).collect()]
    assert got == [model_parse_id(t) for t in texts]


def test_json_keys_in_other_letter_cases(spark):
    # as the service's decoder does, in the one-expression form too
    df = spark.createDataFrame([('{"Customer_ID":5}',), ('{"customer_id":5}',)], "b string")
    v, ok = codec.decode_order("b", strict=True)
    rows = df.select(v.alias("v"), ok.alias("ok")).collect()
    assert rows[0].ok and rows[0].v.customer_id == 5
    assert rows[1].v.customer_id == 5
    assert F is not None
