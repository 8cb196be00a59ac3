from pyspark.sql import functions as F

from storeflow import constants as C
from storeflow.functions import scalars as S
from storeflow.functions import validation as V
from storeflow.schemas import PRODUCT
from storeflow.sources import catalog


def test_generated_catalog_fixture_rows(spark):
    cat = catalog.generate(spark)
    assert cat.count() == 100000
    rows = {r.product_id: r for r in cat.where(F.col("product_id").isin(1, 9, 901, 100000)).collect()}
    assert (rows[1].name, rows[1].category, rows[1].weight) == ("Product Alpha 1", "Electronics", 101)
    assert (rows[9].name, rows[9].category, rows[9].weight) == ("Product Iota 9", "Electronics", 109)
    assert (rows[901].name, rows[901].category, rows[901].weight) == ("Product Alpha 901", "Clothing", 101)
    assert (rows[100000].name, rows[100000].category, rows[100000].weight) == (
        "Product Kappa 100000", "Automotive", 200)
    r = rows[1]
    assert (r.sku, r.manufacturer, r.brand, r.category_id, r.some_other_id) == (
        "SKU-1", "Alpha", "Alpha", 1, 1)
    assert r.description == "Description for product 1 in Electronics category by Alpha"
    agg = cat.agg(F.countDistinct("brand").alias("b"),
                  F.countDistinct("brand", "category").alias("bc"),
                  F.min("weight").alias("lo"), F.max("weight").alias("hi")).first()
    assert (agg.b, agg.bc, agg.lo, agg.hi) == (10, 40, 100, 999)


def test_empty_catalog_and_count(spark):
    assert catalog.count(catalog.empty(spark)).first()[0] == 0


def test_category_id_map(spark):
    df = spark.createDataFrame([(c,) for c in C.CATEGORIES + ["Garden", None]], "c string")
    got = [r[0] for r in df.select(S.category_id("c")).collect()]
    assert got == [1, 2, 3, 4, 5, 6, 7, 8, 1, 1]


BASE = (1, "ABC123", "Test Manufacturer", 1, 100, 1, "Test Product", "Electronics",
        "A test product description", "TestBrand")


def _with(**kw):
    row = dict(zip([f.name for f in PRODUCT.fields], BASE))
    row.update(kw)
    return tuple(row[f.name] for f in PRODUCT.fields)


CASES = [
    ("valid", _with(), None),
    ("zero id", _with(product_id=0), C.MSG_PRODUCT_ID),
    ("empty sku", _with(sku=""), C.MSG_SKU),
    ("long sku", _with(sku="a" * 101), C.MSG_SKU),
    ("sku at 100", _with(sku="a" * 100), None),
    ("multibyte sku", _with(sku="é" * 51), C.MSG_SKU),
    ("negative weight", _with(weight=-1), C.MSG_WEIGHT),
    ("zero weight", _with(weight=0), None),
    ("empty name", _with(name=""), C.MSG_NAME),
    ("name at 200", _with(name="n" * 200), None),
    ("empty category", _with(category=""), C.MSG_CATEGORY),
    ("empty brand", _with(brand=""), C.MSG_BRAND),
    ("empty description", _with(description=""), None),
    ("long description", _with(description="d" * 1001), C.MSG_DESCRIPTION),
    ("manufacturer 201", _with(manufacturer="m" * 201), C.MSG_MANUFACTURER),
    ("category id 0", _with(category_id=0), C.MSG_CATEGORY_ID),
    ("other id 0", _with(some_other_id=0), C.MSG_SOME_OTHER_ID),
    ("two faults", _with(sku="", brand=""), C.MSG_SKU),
]


def test_validation_first_and_all(spark):
    df = spark.createDataFrame([c[1] for c in CASES], PRODUCT)
    got = df.select(V.first_error().alias("e"), V.all_errors().alias("a")).collect()
    for (name, _, want), row in zip(CASES, got):
        assert row.e == want, name
        assert (len(row.a) == 0) == (want is None), name
    assert got[-1].a == [C.MSG_SKU, C.MSG_BRAND]


def test_parse_request_id(spark):
    texts = ["1", "999999", "0", "-1", "abc", "999999999999999", "+5", "007", " 5", "5.5",
             "2147483648", "", "2147483647", None]
    want = [True, True, False, False, False, False, True, True, False, False, False, False, True, False]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(S.valid_id(S.parse_request_id("t"))).collect()]
    assert got == want


def test_positive_default(spark):
    df = spark.createDataFrame([("5",), ("0",), ("-3",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(S.positive_or_default("v", 100)).collect()] == [5, 100, 100, 100, 100]


def test_scan_stored_catalog(spark, tmp_path):
    path = str(tmp_path / "catalog")
    catalog.generate(spark, 500).write.parquet(path)
    got = catalog.scan(spark, path)
    assert got.count() == 500 and got.columns == [f.name for f in PRODUCT.fields]
