"""The stored catalog: bucket-wise upserts, versions, pruned lookups."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from storeflow.operators import keyed as K
from storeflow.sources import catalog
from storeflow.sources.catalog_store import CatalogStore


def files(root):
    return {os.path.relpath(f, root): os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/data/*/*/*.parquet")}


@pytest.fixture()
def store(spark, tmp_path):
    products = catalog.generate(spark, 400)
    s = CatalogStore(spark, str(tmp_path / "cat"), "product_id", products.schema, buckets=16)
    assert s.create(products) == 1
    return s


def test_only_touched_buckets_are_rewritten(spark, store):
    before = files(store.root)
    upd = catalog.generate(spark, 401).where("product_id in (7, 401)").withColumn("name", F.lit("new")).withColumn("seq", F.lit(1))
    assert store.upsert(upd, "seq") == 2
    after = files(store.root)
    touched = store._touched(upd)
    assert 1 <= len(touched) <= 2 and all(after[f] == t for f, t in before.items())
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in set(after) - set(before)} == touched
    rows = {r.product_id: r.name for r in store.read().collect()}
    assert len(rows) == 401 and rows[7] == rows[401] == "new" and rows[8] == "Product Theta 8"
    # the version before is as it was
    assert store.read(1).count() == 400 and store.read(1).where("name = 'new'").isEmpty()
    # whole-table upsert gives the same rows
    whole = K.upsert(store.read(1), upd, "product_id", "seq")
    assert whole.exceptAll(store.read(2)).isEmpty() and store.read(2).exceptAll(whole).isEmpty()


def test_last_write_wins_and_replaces_whole_rows(spark, store):
    upd = catalog.generate(spark, 3).withColumn("seq", F.lit(1)).unionByName(
        catalog.generate(spark, 3).withColumn("brand", F.lit("")).withColumn("weight", F.lit(0)).withColumn("seq", F.lit(2)))
    store.upsert(upd, "seq")
    assert {(r.brand, r.weight) for r in store.get(1, 2, 3).collect()} == {("", 0)}


def test_failed_write_leaves_the_last_version(spark, store, monkeypatch):
    upd = catalog.generate(spark, 20).withColumn("name", F.lit("new")).withColumn("seq", F.lit(1))

    def dies(*a):
        raise RuntimeError("lost before the version was published")
    with monkeypatch.context() as m:
        m.setattr(CatalogStore, "_publish", dies)
        with pytest.raises(RuntimeError):
            store.upsert(upd, "seq")
    assert store.versions() == [1] and store.read().where("name = 'new'").isEmpty()
    # the next try writes over what the first one left, also with other updates
    assert store.upsert(upd.where("product_id <= 5"), "seq") == 2
    assert sorted(r.product_id for r in store.read().where("name = 'new'").collect()) == [1, 2, 3, 4, 5]
    assert store.read().count() == 400


def test_empty_catalog_and_second_create(spark, tmp_path):
    s = CatalogStore(spark, str(tmp_path / "c"), "product_id", catalog.generate(spark, 1).schema)
    assert s.versions() == [] and s.create(catalog.empty(spark)) == 1 and s.read().count() == 0
    s.upsert(catalog.generate(spark, 30).withColumn("seq", F.lit(1)), "seq")
    assert s.read().count() == 30 and s.read(1).count() == 0
    with pytest.raises(ValueError):
        s.create(catalog.generate(spark, 1))


def scanned(df):
    """Rows that the scans of a plan gave out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.size()) if "Scan parquet" in leaves.apply(k).nodeName())


def test_lookup_skips_row_groups_by_bloom_filter(spark, tmp_path):
    even = catalog.generate(spark, 20000).where("product_id % 2 = 0")
    s = CatalogStore(spark, str(tmp_path / "c"), "product_id", even.schema, buckets=1)
    s.create(even)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan's leaves are not its scans
    try:
        assert scanned(s.get(10001)) == 0  # inside the range of ids, and not there
        assert scanned(s.get(10000)) > 0
        spark.conf.set("spark.sql.parquet.filterPushdown", "false")
        assert scanned(s.get(10001)) == 10000
    finally:
        spark.conf.set("spark.sql.parquet.filterPushdown", "true")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r.product_id for r in s.get(10000, 10001).collect()] == [10000] and s.get().count() == 0


def test_lookup_of_requests_reads_only_their_buckets(spark, store):
    reqs = spark.createDataFrame([(1, 7), (2, 9999), (3, None), (4, 7)], "request_id int, pid bigint")
    out = store.lookup(reqs, "pid")
    assert {(r.request_id, r.pid, r.found, r.name) for r in out.collect()} == {
        (1, 7, True, "Product Eta 7"), (2, 9999, False, None), (3, None, False, None), (4, 7, True, "Product Eta 7")}
    read = {f.split("bucket=")[1].split("/")[0] for f in store.read(only=store._touched(reqs.where("pid is not null").withColumnRenamed("pid", "product_id"))).inputFiles()}
    assert len(read) <= 2
