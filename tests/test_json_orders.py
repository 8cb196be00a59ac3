from pyspark.sql import functions as F

from storeflow import constants as C
from storeflow.operators import orders as O
from storeflow.sources import codec, synth

CASES = [  # text, lenient ok, strict ok
    ('{"customer_id":7,"items":[{"product_id":1,"quantity":2,"price":9.99}]}', True, True),
    ('{"customer_id":"x"}', False, False),
    ('{"customer_id":1.5}', False, False),
    ('{"bad":', False, False),
    ('{"customer_id":1} trailing', True, False),
    ('{"customer_id":5,"customer_id":6}', True, True),
    ("[]", False, False),
    ("null", True, True),
    ("", False, False),
    ('{"items":null}', True, True),
    ('{"order_id":5}', False, False),
    ('{"items":[{"product_id":"z"}]}', False, False),
]


def test_order_decode_table(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "body string")
    lv, lok = codec.decode_order("body", strict=False)
    _, sok = codec.decode_order("body", strict=True)
    got = df.select(lok.alias("l"), sok.alias("s"), lv.alias("v")).collect()
    for (text, lw, sw), row in zip(CASES, got):
        assert (row.l, row.s) == (lw, sw), text
    assert got[5].v.customer_id == 6
    assert got[7].v.customer_id == 0 and got[7].v.items == []
    assert got[9].v.items == []


def test_product_decode_rejects_number_for_string(spark):
    df = spark.createDataFrame([('{"product_id":1,"sku":5}',), ('{"product_id":1,"sku":"5"}',),
                                ('{"product_id":3000000000}',)], "body string")
    _, ok = codec.decode_product("body")
    assert [r[0] for r in df.select(ok).collect()] == [False, True, False]


def test_item_count_and_defaults(spark):
    df = spark.createDataFrame([("", None), ("x", [])], "order_id string, items array<struct<product_id:bigint,quantity:bigint,price:double>>")
    rows = df.select(O.item_count("items").alias("n"),
                     O.default_order_id("order_id", F.lit("gen")).alias("id")).collect()
    assert [(r.n, r.id) for r in rows] == [(0, "gen"), (0, "x")]


def test_sync_pipeline(spark):
    df = spark.createDataFrame([('{"customer_id":7,"items":[{"product_id":1,"quantity":2,"price":9.99}]}',)], "body string")
    v, ok = codec.decode_order("body", strict=False)
    dec = df.select(v.alias("o")).select("o.*")
    out = O.sync_response(O.process_sync(dec, generated_id=F.lit("g1"))).first()
    assert (out.message, out.order_id, out.status) == (C.MSG_ORDER_SYNC, "g1", C.STATUS_COMPLETED)


def test_encode_roundtrip(spark):
    df = spark.createDataFrame([("a", 1, "pending", [(1, 2, 9.99)])],
                               "order_id string, customer_id bigint, status string, items array<struct<product_id:bigint,quantity:bigint,price:double>>")
    df = df.withColumn("created_at", F.lit("2025-10-25 22:25:07.5").cast("timestamp"))
    body = codec.encode(O.order_struct(df))
    v, ok = codec.decode_order(body, strict=True)
    r = df.select(body.alias("b"), v.alias("v"), ok.alias("ok")).first()
    assert r.ok and r.v.items[0].price == 9.99 and r.v.created_at is not None
    assert '"created_at":"2025-10-25T22:25:07.5Z"' in r.b or '"created_at":"2025-10-25T22:25:07.500' in r.b


def test_nest_lines_gives_one_document_per_order(spark):
    lines = spark.range(0, 1000).select(F.lit(1).alias("k"), F.col("id").alias("line"))
    nested = O.nest_lines(lines, "k", F.struct("line"))
    assert [r[0] for r in nested.select(F.size("items")).collect()] == [1000]
    numbers = O.unnest(O.nest_lines(lines, "k", F.struct(F.col("line").alias("product_id"), F.lit(1).alias("quantity"),
                                                         F.lit(1.0).alias("price"))), ["k"])
    assert sorted(r.line_no for r in numbers.collect()) == list(range(1000))


GO_VERDICTS = [  # body, decoded by the service
    ('{"created_at":"2025-10-25T22:25:07.123456789Z"}', True), ('{"created_at":"2025-10-25T22:25:07Z"}', True),
    ('{"created_at":"2025-10-25T22:25:07.1+02:00"}', True), ('{"created_at":"2025-10-25"}', False),
    ("{'order_id':'a'}", False), ('{"items":[{"price":"NaN"}]}', False), ('{"items":[{"price":NaN}]}', False),
    ('{"items":[{"price":Infinity}]}', False), ('{"items":[null,{"product_id":3}]}', True), ('{"items":[{"price":"1.5"}]}', False),
]


def test_decoder_gives_the_services_verdicts(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(GO_VERDICTS)], "i int, body string")
    for strict in (True, False):
        rows = {r.i: r for r in codec.decode_rows(df, "body", "order", strict=strict).collect()}
        assert [rows[i].ok for i in range(len(GO_VERDICTS))] == [ok for _, ok in GO_VERDICTS]
        assert rows[0].value.created_at.microsecond == 123456
        assert [tuple(x) for x in rows[8].value["items"]] == [(0, 0, 0.0), (3, 0, 0.0)]


def test_synthetic_orders_ranges(spark):
    so = synth.orders(spark.range(0, 2000).withColumnRenamed("id", "k"), "k")
    lines = O.unnest(so.withColumnRenamed("order_key", "order_id"))
    a = so.agg(F.min(F.size("items")), F.max(F.size("items")), F.min("customer_id"), F.max("customer_id")).first()
    assert (a[0], a[1]) == (1, 3) and 1 <= a[2] and a[3] <= 10000
    b = lines.agg(F.min("product_id"), F.max("product_id"), F.min("quantity"), F.max("quantity"),
                  F.min("price"), F.max("price")).first()
    assert 1 <= b[0] and b[1] <= 1000 and (b[2], b[3]) == (1, 5) and 9.99 <= b[4] and b[5] <= 199.99
    # same key -> same order, whatever the partitioning
    again = synth.orders(spark.range(0, 2000, numPartitions=3).withColumnRenamed("id", "k"), "k")
    assert so.exceptAll(again).count() == 0


def test_traffic_mix_drops_health(spark):
    t = synth.product_traffic(spark.range(0, 16000).withColumnRenamed("id", "k"), "k")
    kinds = {r.kind: r["count"] for r in t.groupBy("kind").count().collect()}
    assert "health" not in kinds and set(kinds) == {"get", "add", "missing", "invalid"}
    assert kinds["get"] > kinds["add"] > kinds["missing"]


def test_split_decoded_and_elapsed(spark):
    from storeflow.functions import scalars as S
    df = spark.createDataFrame([("a", '{"customer_id":1}'), ("b", "{oops")], "id string, body string")
    good, bad = codec.split_decoded(df, "body", "order", strict=True)
    assert [r.id for r in good.collect()] == ["a"] and [r.id for r in bad.collect()] == ["b"]
    assert good.first().value.customer_id == 1
    t = spark.createDataFrame([("2025-10-25 22:25:07", "2025-10-25 22:25:10.5")], "s string, e string")
    t = t.select(F.col("s").cast("timestamp").alias("s"), F.col("e").cast("timestamp").alias("e"))
    assert t.select(S.elapsed_ms("s", "e")).first()[0] == 3500.0


def test_unnest_outer_keeps_empty_orders(spark):
    df = spark.createDataFrame([("a", [(1, 2, 9.99), (3, 1, 5.0)]), ("b", [])],
                               "order_id string, items array<struct<product_id:bigint,quantity:bigint,price:double>>")
    assert O.unnest(df).count() == 2
    rows = O.unnest(df, outer=True).orderBy("order_id", "line_no").collect()
    assert [(r.order_id, r.line_no, r.product_id) for r in rows] == [("a", 0, 1), ("a", 1, 3), ("b", None, None)]


def decoded(spark, texts, kind="order", strict=False):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {r.i: (r.ok, r.value) for r in codec.decode_rows(df, "t", kind, strict=strict).collect()}


def test_white_space_around_null_and_numbers_out_of_range(spark):
    for strict in (True, False):
        got = decoded(spark, ["null\n", "\tnull", " null ", "\r\nnull", "nul", '{"items":[{"price":1e400}]}', '{"items":[{"price":-1e400},{"price":1}]}',
                              '{"items":[{"price":1e300}]}', '{"items":[{"price":1e-400}]}', "\n\t ", '\n{"customer_id":1}\n'], strict=strict)
        assert [got[i][0] for i in range(11)] == [True, True, True, True, False, False, False, True, True, False, True]
    assert got[10][1].customer_id == 1


def test_keys_in_any_letter_case(spark):
    got = decoded(spark, ['{"Customer_ID":7,"ITEMS":[{"Product_Id":3,"QUANTITY":2,"Price":1.5}],"Status":"x"}',
                          '{"customer_id":5,"CUSTOMER_ID":6}', '{"CUSTOMER_ID":5,"customer_id":6}', '{"Customer_ID" : "x"}',
                          '{"order_id":"a \\"Customer_ID\\": 9","customer_id":4}', '{"other":{"Status":1},"customer_id":1}', '{"\u017ftatus":"folded"}',
                          '{"order_id":"Customer_ID"}'], strict=True)
    v = got[0][1]
    assert got[0][0] and (v.customer_id, v.status, v["items"][0].product_id, v["items"][0].quantity, v["items"][0].price) == (7, "x", 3, 2, 1.5)
    assert got[1][1].customer_id == 6 and got[2][1].customer_id == 6
    assert not got[3][0]
    assert got[4][1].order_id == 'a "Customer_ID": 9' and got[4][1].customer_id == 4
    assert got[5][1].customer_id == 1 and got[6][1].status == "folded" and got[7][1].order_id == "Customer_ID"
    p = decoded(spark, ['{"Product_ID":1,"SKU":"s","Name":"n"}'], "product")[0]
    assert p[0] and (p[1].product_id, p[1].sku, p[1].name) == (1, "s", "n")


def test_keys_are_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "t string")
    plan = codec.decode_rows(df, "t", "order", strict=True).where("ok")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_encoded_orders_have_all_fields(spark):
    rows = spark.createDataFrame([(1, None, None, None, None, None)], "k int, order_id string, customer_id bigint, status string, "
                                 "items array<struct<product_id:bigint,quantity:bigint,price:double>>, created_at timestamp")
    body = rows.select(codec.encode_order(O.order_struct(rows)).alias("b")).first().b
    assert body.startswith('{"order_id":"","customer_id":0,"status":"","items":null,"created_at":"0001-01-01T00:00:00')
    back = codec.decode_rows(spark.createDataFrame([(body,)], "t string"), "t", "order", strict=True)
    r = back.select("ok", F.size("value.items").alias("n"), "value.order_id", F.year("value.created_at").alias("y")).first()
    assert (r.ok, r.n, r.order_id, r.y) == (True, 0, "", 1)


def test_items_are_ordered_by_line(spark):
    rows = spark.createDataFrame([(1, n, 100 - n) for n in (3, 1, 2, 7, 5)] + [(1, 3, 5)], "k int, line int, product_id bigint").repartition(4)
    nested = O.nest_lines(rows, "k", F.struct("product_id"), F.col("line")).first()
    assert [x.product_id for x in nested["items"]] == [99, 98, 5, 97, 95, 93]
