import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from storeflow.streaming import lifecycle as LC
from storeflow.streaming import orders_stream as ST
from storeflow.streaming import replay as RP
from storeflow.streaming import retry as RT


def _write_queue_file(folder, name, messages):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        for m in messages:
            fh.write(json.dumps(m) + "\n")


def _msg(mid, order_id, created="2025-10-25T22:25:07Z", body=None):
    b = body if body is not None else json.dumps(
        {"order_id": order_id, "customer_id": 1, "status": "pending",
         "items": [{"product_id": 1, "quantity": 2, "price": 9.99}], "created_at": created})
    return {"message_id": mid, "attributes": {"order_id": order_id}, "body": b}


def _run(spark, queue, root):
    ST.drain(ST.run_processor(ST.queue_stream(spark, queue, max_files_per_trigger=1), os.path.join(root, "out"), os.path.join(root, "ck")))
    read = lambda n, s: spark.read.schema(s).parquet(os.path.join(root, "out", n))
    return (read("completed", "order_id string, status string, n_items long, batch int"),
            read("dead_letter", "message_id string, reason string, raw string, batch int"))


def test_dedupe_poison_and_restart(spark, tmp_path):
    queue, root = str(tmp_path / "q"), str(tmp_path / "run")
    _write_queue_file(queue, "a.json", [_msg("m1", "o1"), _msg("m2", "o2"), _msg("m1b", "o1"),
                                        _msg("bad", "x", body='{"customer_id":1} trailing'),
                                        _msg("bad", "x", body='{"customer_id":1} trailing'),
                                        _msg("nots", "o9", body='{"order_id":"o9"}')])
    _write_queue_file(queue, "b.json", [_msg("m3", "o3"), _msg("m2b", "o2", created="2025-10-25T22:26:00Z")])
    done, dead = _run(spark, queue, root)
    # an order without a time is completed; dead messages are all kept
    assert sorted(r.order_id for r in done.collect()) == ["o1", "o2", "o3", "o9"]
    assert {r.status for r in done.collect()} == {"completed"}
    assert sorted((r.message_id, r.reason) for r in dead.collect()) == [("bad", "decode"), ("bad", "decode")]
    # restart from the checkpoint: nothing is processed twice, new files are
    _write_queue_file(queue, "c.json", [_msg("m4", "o4"), _msg("m1c", "o1")])
    done, _ = _run(spark, queue, root)
    assert sorted(r.order_id for r in done.collect()) == ["o1", "o2", "o3", "o4", "o9"]


def test_no_order_is_late(spark, tmp_path):
    """Orders out of time order, one file a batch: each is completed."""
    queue, root = str(tmp_path / "q"), str(tmp_path / "run")
    for i, day in enumerate((25, 1, 20, 2, 28, 3)):
        _write_queue_file(queue, f"{i}.json", [_msg(f"m{i}", f"o{i}", created=f"2025-10-{day:02}T00:00:00Z")])
        os.utime(os.path.join(queue, f"{i}.json"), (1_760_000_000 + i, 1_760_000_000 + i))
    _write_queue_file(queue, "z.json", [_msg("null", "", body="null"), _msg("none", "", body='{"customer_id":3}'), _msg("none", "", body='{"customer_id":3}')])
    done, dead = _run(spark, queue, root)
    assert sorted(r.order_id for r in done.collect()) == ["", "", "o0", "o1", "o2", "o3", "o4", "o5"]
    assert dead.count() == 0


def test_accept_rejects_and_publishes(spark, tmp_path):
    big = json.dumps({"customer_id": 1, "items": [{"product_id": 1, "quantity": 1, "price": 1.25}] * 8000})
    reqs = spark.createDataFrame([(1, '{"customer_id":7,"items":[]}'), (2, '{"bad":'),
                                  (3, '{"customer_id":1} trailing'), (4, big)], "rid long, body string")
    ids = {"generated_id": F.concat(F.lit("g"), F.col("rid").cast("string")), "message_id": F.col("rid").cast("string")}
    pub, rej = ST.accept(reqs, **ids)
    rows = pub.collect()
    assert sorted(r.attributes["order_id"] for r in rows) == ["g1", "g3"]
    assert all('"status":"pending"' in r.body for r in rows)
    assert sorted((r.rid, r.status_code, r.error) for r in rej.collect()) == [(2, 400, "INVALID_INPUT"), (4, 500, "PUBLISH_FAILED")]
    assert sorted(r.status_code for r in ST.judged(reqs, topic=False, **ids).collect()) == [400, 503, 503, 503]


def test_publish_fans_out_once(spark, tmp_path):
    src = str(tmp_path / "requests")
    os.makedirs(src)
    spark.createDataFrame([(1, '{"customer_id":7,"items":[]}'), (2, '{"customer_id":8}'), (3, "no")],
                          "rid long, body string").write.parquet(src + "/part")
    reqs = ST.table_stream(spark, src + "/part", "rid long, body string")
    judge = lambda b: ST.judged(b, now=F.lit("2025-10-25 22:25:07").cast("timestamp"),
                                generated_id=F.concat(F.lit("g"), F.col("rid").cast("string")),
                                message_id=F.col("rid").cast("string"))
    queues = [str(tmp_path / "q1"), str(tmp_path / "q2")]
    for ck in ("ck", "ck-again"):  # the second run repeats batch 0 from the start
        ST.drain(ST.publish(reqs, judge, queues, str(tmp_path / "rejected"), str(tmp_path / ck)))
        for q in queues:
            rows = spark.read.text(q).collect()
            assert sorted(json.loads(r.value)["attributes"]["order_id"] for r in rows) == ["g1", "g2"]
        assert [r.rid for r in spark.read.parquet(str(tmp_path / "rejected")).collect()] == [3]


def test_stream_queries_on_a_folder_in_mixed_order(spark, tmp_path):
    """The events table as a folder of files in mixed time order, one file a
    batch: every stream query gives its batch answer, and nothing is lost."""
    import duckdb

    import __spark_entry__ as E
    sf = str(tmp_path / "sf")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i in range(5):
        part = ev.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == i)
        part.coalesce(1).write.mode("append").parquet(os.path.join(sf, "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{sf}/events.parquet/*.parquet')")
    rows = {}
    for name in ("stream_orders", "stream_dead_letter", "stream_rejected", "stream_audit", "stream_arrivals", "stream_status_latest", "stream_final_windows", "stream_retry", "orders_accepted"):
        got = E.queries()[name](spark, sf)
        rel = con.sql(E.oracle_sql()[name])
        order = sorted(got.columns)
        assert order == sorted(rel.columns)
        idx = [rel.columns.index(c) for c in order]
        want = sorted((tuple(r[i] for i in idx) for r in rel.fetchall()), key=repr)
        found = sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr)
        assert found == want, name
        rows[name] = len(found)
    assert rows["stream_orders"] + rows["stream_rejected"] + rows["stream_dead_letter"] == ev.count()


def test_kafka_record_mapping_round_trip(spark):
    msgs = spark.createDataFrame([("m1", {"order_id": "o1"}, '{"order_id":"o1"}')],
                                 "message_id string, attributes map<string,string>, body string")
    rec = ST.to_kafka_records(msgs)
    r = rec.first()
    assert r.key == "o1" and r.value == '{"order_id":"o1"}'
    back = ST.from_kafka_records(rec.select(F.col("key").cast("binary").alias("key"),
                                            F.col("value").cast("binary").alias("value"), "headers")).first()
    assert (back.message_id, back.attributes, back.body) == ("m1", {"order_id": "o1"}, '{"order_id":"o1"}')


def test_latest_versions_keeps_newest_batch(spark, tmp_path):
    out = str(tmp_path / "upd")
    spark.createDataFrame([(1, "pending"), (2, "pending")], "k long, s string").write.parquet(out + "/batch=0")
    spark.createDataFrame([(1, "completed")], "k long, s string").write.parquet(out + "/batch=1")
    got = {r.k: r.s for r in ST.latest_versions(spark, out, ["k"]).collect()}
    assert got == {1: "completed", 2: "pending"}


def test_messages_without_any_id_are_all_completed(spark, tmp_path):
    """Five orders without order id and message id: nothing says that one is a
    redelivery of another, so none goes; dead messages take no state."""
    queue, root = str(tmp_path / "q"), str(tmp_path / "run")
    body = json.dumps({"customer_id": 7, "items": []})
    _write_queue_file(queue, "a.json", [{"attributes": {}, "body": body}] * 3 + [_msg("m1", "o1"), _msg("m1", "o1")])
    _write_queue_file(queue, "b.json", [{"message_id": "", "body": body}, {"body": body}, {"body": "{"}, {"message_id": "x"}])
    done, dead = _run(spark, queue, root)
    assert sorted(r.order_id for r in done.collect()) == [""] * 5 + ["o1"]
    assert sorted(r.reason for r in dead.collect()) == ["decode", "no body"]


def test_dead_letters_hold_no_state(spark, tmp_path):
    queue, root = str(tmp_path / "q"), str(tmp_path / "run")
    _write_queue_file(queue, "a.json", [_msg(f"bad{i}", "x", body="{") for i in range(50)] + [_msg("m1", "o1"), _msg("m2", "o2")])
    _, complete = queries = ST.run_processor(ST.queue_stream(spark, queue), os.path.join(root, "out"), os.path.join(root, "ck"))
    ST.drain(queries)
    assert max(o["numRowsTotal"] for p in complete.recentProgress for o in p["stateOperators"]) == 2


def test_killed_between_two_queues(spark, tmp_path, monkeypatch):
    """The batch dies after the first queue was written; the retry gives the
    second queue the same ids, though ids and times are drawn at random."""
    src, queues = str(tmp_path / "requests"), [str(tmp_path / "q1"), str(tmp_path / "q2")]
    spark.createDataFrame([(i, '{"customer_id":7}') for i in range(20)], "rid long, body string").write.parquet(src)
    run = lambda: ST.drain(ST.publish(ST.table_stream(spark, src, "rid long, body string"), ST.judged, queues, str(tmp_path / "rejected"), str(tmp_path / "ck")))
    write = ST.write_once

    def dies(df, path, *a, **kw):
        if "/q2/" in path:
            raise RuntimeError("lost")
        write(df, path, *a, **kw)
    monkeypatch.setattr(ST, "write_once", dies)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(ST, "write_once", write)
    run()
    first, second = (sorted((m["message_id"], m["attributes"]["order_id"], m["body"]) for m in (json.loads(r.value) for r in spark.read.text(q).collect())) for q in queues)
    assert len(first) == 20 and first == second


def test_receive_limit_of_ten_messages(spark, tmp_path):
    """L4: no micro-batch holds more than ten messages, and a consumer that
    stops and starts again loses none."""
    src, queue, root = str(tmp_path / "requests"), str(tmp_path / "q"), str(tmp_path / "run")
    reqs = spark.range(57).select(F.col("id").alias("rid"), F.lit('{"customer_id":7}').alias("body"))
    reqs.repartition(3).write.parquet(src)
    judge = lambda b: ST.judged(b, generated_id=F.concat(F.lit("g"), F.col("rid").cast("string")), message_id=F.col("rid").cast("string"))
    ST.drain(ST.publish(ST.table_stream(spark, src, "rid long, body string"), judge, [queue], str(tmp_path / "rejected"), str(tmp_path / "ck"),
                        records_per_file=10))
    split = lambda: ST.split_queue(ST.queue_stream(spark, queue, 1), os.path.join(root, "out"), os.path.join(root, "ck", "split"), False)
    sizes = []
    for stop_after in (2, 10 ** 9):
        q = split()
        while q.isActive and sum(1 for p in q.recentProgress if p["numInputRows"]) < stop_after:
            if stop_after > 2 and not q.status["isDataAvailable"] and q.lastProgress and not q.status["isTriggerActive"]:
                q.processAllAvailable()
                break
        q.stop()
        sizes += [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    ST.drain(ST.complete_received(spark, os.path.join(root, "out"), os.path.join(root, "ck", "complete")))
    assert max(sizes) <= 10
    done = spark.read.schema("order_id string, batch int").parquet(os.path.join(root, "out", "completed"))
    assert sorted(r.order_id for r in done.collect()) == sorted(f"g{i}" for i in range(57))


DAY_MS = 86_400_000


def _replay(spark, tmp_path, rows, schema, place, files=None):
    df = spark.createDataFrame(rows, schema)
    path = RP.write_places(df, place, str(tmp_path / "in"))
    return RP.stream(spark, path, schema + ", place int").drop("place")


def test_status_expires_once_and_gives_up_its_state(spark, tmp_path):
    start = 1_700_000_000
    # key a goes silent, b comes back after it expired, c stays; a fifth day of c's events moves the watermark on
    rows = [("a", "new", 1, start), ("b", "new", 2, start), ("c", "new", 3, start), ("a", "late", 0, start + 60), ("c", "more", 4, start + 3 * 86400),
            ("c", "more", 5, start + 6 * 86400), ("c", "more", 6, start + 7 * 86400), ("b", "back", 7, start + 8 * 86400), ("c", "last", 8, start + 8 * 86400), (None, None, 9, start + 8 * 86400)]
    df = [(k, s, q, datetime.datetime.fromtimestamp(t, datetime.timezone.utc)) for k, s, q, t in rows]
    ev = _replay(spark, tmp_path, df, "k string, status string, seq bigint, ts timestamp", F.floor((F.unix_seconds("ts") - start) / 86400).cast("int"))
    q = ST.run_append_sink(LC.latest_status(ev, ["k"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    ST.drain(q)
    schema = "k string, status string, last_seq long, last_ms long, expired boolean"
    told = spark.read.schema(schema).parquet(str(tmp_path / "out"))
    assert sorted((r.k, r.status, r.last_seq) for r in told.where("expired").collect()) == [("a", "new", 1), ("b", "new", 2)]
    got = {r.k: (r.status, r.last_seq, r.expired) for r in LC.newest(spark, str(tmp_path / "out"), schema, ["k"]).collect()}
    assert got == {"a": ("new", 1, True), "b": ("back", 7, False), "c": ("last", 8, False), None: (None, 9, False)}
    states = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    assert max(states) == 3 and states[-1] == 3  # b, c and the null key; not a


def test_every_row_is_in_a_final_window_or_late(spark, tmp_path):
    start = 1_700_000_000 // 86400 * 86400
    hours = [0, 30, 1, 31, 60, 2, 33, 61, 90, 200]  # the last row closes what came before
    df = [("e" if k % 3 else None, datetime.datetime.fromtimestamp(start + h * 3600, datetime.timezone.utc), k) for k, h in enumerate(hours)]
    ev = _replay(spark, tmp_path, df, "event_type string, ts timestamp, n int", F.col("n")).drop("n")
    ST.drain(ST.run_append_sink(LC.final_windows(ev, ["event_type"], DAY_MS, delay="10 hours"), str(tmp_path / "out"), str(tmp_path / "ck")))
    rows = spark.read.schema("event_type string, window_ms long, bucket int, arrivals long, late boolean").parquet(str(tmp_path / "out")).collect()
    # plain replay: a row is late when its window's end is not after the greatest earlier time less the delay
    final, late, seen = {}, 0, None
    for k, h in enumerate(hours):
        if seen is not None and (h // 24 + 1) * 24 <= seen - 10:
            late += 1
        else:
            final[k % 3 > 0, h // 24] = final.get((k % 3 > 0, h // 24), 0) + 1
        seen = h if seen is None else max(seen, h)
    got = {}
    for r in rows:
        if not r.late:
            key = (r.event_type is not None, (r.window_ms // 1000 - start) // 86400)
            got[key] = got.get(key, 0) + r.arrivals
    assert late == sum(r.arrivals for r in rows if r.late) > 0
    assert got == {k: n for k, n in final.items() if k[1] < 8}  # the closing row's own window is still open
    assert sum(got.values()) + late + 1 == len(hours)


def test_elapsed_tells_unmatched_arrivals_once(spark, tmp_path):
    at = lambda h: datetime.datetime.fromtimestamp(1_700_000_000 + 3600 * h, datetime.timezone.utc)
    a = [(1, at(0)), (2, at(1)), (3, at(30)), (4, at(31)), (-1, at(500))]
    c = [(1, at(5)), (1, at(20)), (1, at(90)), (3, at(29)), (4, at(31)), (9, at(40)), (-2, at(500))]
    for name, rows, cols in (("a", a, "k bigint, arrived_at timestamp"), ("c", c, "k bigint, completed_at timestamp")):
        df = spark.createDataFrame(rows, cols)
        RP.write_places(df, F.floor(F.unix_seconds(cols.split()[2]) / 90000).cast("int"), str(tmp_path / name))
    joined = LC.elapsed(RP.stream(spark, str(tmp_path / "a"), "k bigint, arrived_at timestamp"), RP.stream(spark, str(tmp_path / "c"), "k bigint, completed_at timestamp"),
                        "k", 86400, delay="2 hours")
    ST.drain(ST.run_append_sink(joined.select("k", "elapsed_ms"), str(tmp_path / "out"), str(tmp_path / "ck")))
    got = [(r.k, r.elapsed_ms) for r in spark.read.schema("k bigint, elapsed_ms double").parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == sorted([(1, 18_000_000.0), (1, 72_000_000.0), (2, None), (3, None), (4, 0.0)], key=str)


def test_dead_letters_are_requeued_or_expire_once(spark, tmp_path):
    queue, out = str(tmp_path / "q"), str(tmp_path / "out")
    _write_queue_file(queue + "/retry=-2", "a.json", [_msg("ok", "o1"), _msg("fix", "o2", body='{"order_id":"o2"}}'), _msg("never", "o3", body="[]"), {"message_id": "none"}])
    split = lambda: ST.drain(ST.split_queue(ST.queue_stream(spark, queue), out, str(tmp_path / "ck-split")))
    split()
    first = spark.read.parquet(out + "/dead_letter").agg(F.max("enqueued_at")).first()[0]
    day = lambda k: F.lit(first) + F.expr(f"interval {k} days")
    repair = lambda m: F.when(F.col("body").endswith("}}") & (F.col("attempts") >= 2), F.rtrim("body", F.lit("}")).substr(F.lit(1), F.lit(10 ** 6)))
    rounds = [repair, lambda m: F.when(F.col("body").endswith("}}"), F.expr("substr(body, 1, length(body) - 1)"))]
    for k in range(1, 7):
        again = 2 if k == 3 else 1  # the third round runs twice, as after a lost driver
        for _ in range(again):
            RT.run_round(spark, out, queue, k - 1, day(k), rounds[min(k - 1, 1)])
        if k == 4:  # a new dead letter comes in while others wait
            _write_queue_file(queue + "/retry=-1", "b.json", [_msg("later", "o4", body="no")])
            split()
    ST.drain(ST.run_processor(ST.queue_stream(spark, queue), out, str(tmp_path / "ck")))
    done = spark.read.schema("order_id string, message_id string, attempt int, batch int").parquet(out + "/completed").collect()
    assert sorted((r.message_id, r.order_id, r.attempt) for r in done) == [("fix", "o2", 2), ("ok", "o1", 0)]
    assert sorted((r.message_id, r.attempts) for r in RT.expired(spark, out).collect()) == [("later", 1), ("never", 4), ("none", 4)]


def test_final_windows_with_another_state_store(spark, tmp_path):
    """The query brings the state store its timers need, whatever the session
    has, and leaves the session as it was."""
    import __spark_entry__ as E
    ev = spark.range(400).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"),
                                 F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(id), 0, 0)").alias("ts"))
    ev.write.parquet(str(tmp_path / "events.parquet"))
    name, other = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, other)
    try:
        rows = E.queries()["stream_final_windows"](spark, str(tmp_path)).collect()
        assert spark.conf.get(name) == other
    finally:
        spark.conf.set(name, before)
    assert sum(r.arrivals + r.late_arrivals for r in rows) == 400


def test_status_of_many_keys_is_held_in_buckets(spark, tmp_path):
    """Four buckets hold the state of a hundred keys; those unseen expire, the
    others stay, and the greatest (seq, status) counts."""
    at = lambda d: datetime.datetime.fromtimestamp(1_700_000_000 + 86400 * d, datetime.timezone.utc)
    rows = [(k, f"s{k}-{v}", v // 2, at(0)) for k in range(100) for v in (3, 2, 1)] + [(k, f"new{k}", 9, at(8)) for k in range(50)] + [(-1, "end", 1, at(9))]
    ev = _replay(spark, tmp_path, rows, "k bigint, status string, seq bigint, ts timestamp", F.floor((F.unix_seconds("ts") - 1_700_000_000) / 86400).cast("int"))
    q = ST.run_append_sink(LC.latest_status(ev, ["k"], buckets=4), str(tmp_path / "out"), str(tmp_path / "ck"))
    ST.drain(q)
    schema = "k bigint, status string, last_seq long, last_ms long, expired boolean"
    got = {r.k: (r.status, r.last_seq, r.expired) for r in LC.newest(spark, str(tmp_path / "out"), schema, ["k"]).collect()}
    assert got == {k: (f"new{k}", 9, False) if k < 50 else (f"s{k}-3", 1, True) for k in range(100)} | {-1: ("end", 1, False)}
    assert 0 < max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= 4


def test_a_large_place_is_several_files_and_one_batch(spark, tmp_path):
    """Places of many and of few rows: no task writes a large one whole, and
    each is one micro-batch, in order."""
    df = spark.range(0, 200_000, 1, 8).select(F.col("id").alias("n"), F.xxhash64("id").alias("x"))
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "200k")
    try:
        path = RP.write_places(df, F.when(F.col("n") < 150_000, 0).when(F.col("n") < 199_000, 1).otherwise(2), str(tmp_path / "in"))
    finally:
        spark.conf.set(name, before)
    assert sum(f.endswith(".parquet") for f in os.listdir(os.path.join(path, "place=0"))) > 2
    q = ST.run_append_sink(RP.stream(spark, path, "n bigint, x bigint, place int"), str(tmp_path / "out"), str(tmp_path / "ck"))
    ST.drain(q)
    got = spark.read.schema("n bigint, place int, batch int").parquet(str(tmp_path / "out")).groupBy("batch", "place").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 150_000), (1, 1, 49_000), (2, 2, 1_000)]


def test_number_of_batches_does_not_grow_with_files(spark, tmp_path, monkeypatch):
    """A table of many files and its messages are taken in a few micro-batches."""
    import __spark_entry__ as E
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    ev.repartition(20).write.parquet(str(tmp_path / "events.parquet"))
    queries, drain = [], ST.drain
    monkeypatch.setattr(ST, "drain", lambda qs: (drain(qs), queries.extend(qs if isinstance(qs, list) else [qs])))
    for name, n in (("stream_dead_letter", ev.where("event_type = 'error'").count()), ("stream_retry", ev.count())):
        queries.clear()
        assert E.queries()[name](spark, str(tmp_path)).count() == n
        assert max(sum(p["numInputRows"] > 0 for p in q.recentProgress) for q in queries) <= 2
