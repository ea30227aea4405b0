from pyspark.sql import functions as F

from revlake.operators import views
from revlake.sources.store import Store
from revlake.streaming import live

LOG = "key string, rev long, value string"


def test_store_flush_read_compact(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    store = Store(spark, f"file://{tmp_path}/db", _parse_datatype_string(LOG))
    (tmp_path / "db").mkdir()
    assert store.read().count() == 0 and store.max_rev() == 0
    store.flush(spark.createDataFrame([("a", 1, "1"), ("b", 2, "2")], LOG))
    store.flush(spark.createDataFrame([("a", 3, None), ("z", 4, "4")], LOG))
    assert store.max_rev() == 4
    assert [(r.key, r.value) for r in views.latest(store.read()).orderBy("key").collect()] == [("b", "2"), ("z", "4")]
    assert [r.key for r in store.read("y").collect()] == ["z"]
    before = sorted(map(tuple, views.latest(store.read(), True).collect()))
    store.compact()
    assert sorted(map(tuple, views.latest(store.read(), True).collect())) == before
    assert len(store.batches()) == 1 and store.vacuum() == 0  # what was replaced stays for readers that have begun
    assert store.vacuum(retention_ms=0) == 2
    assert store.read().count() == 3


def test_watch_stream(spark, tmp_path):
    source = f"file://{tmp_path}/log"
    spark.createDataFrame([("a1", 1, ""), ("b", 2, ""), ("a2", 3, "")], LOG).coalesce(1).write.parquet(source)
    subs = spark.createDataFrame([(1, "prefix", "a", False, 1), (2, "all", None, True, None)], "id long, type string, pattern string, once boolean, last_seen_rev long")
    got = []
    q = live.watch(live.read_log(spark, source, spark.createDataFrame([], LOG).schema), subs, lambda rows, _: got.extend((r.id, r.rev) for r in rows.collect()), f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    assert sorted(got) == [(1, 3), (2, 1)]


def test_lease_expiry_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    kind = "key string, rev long, value string, created_at_ms long, lease_id long, lease_expires_at_ms long"
    source = f"file://{tmp_path}/log"
    spark.createDataFrame([("m1", 1, "", 1000, 1, 2000), ("m2", 2, "", 1100, 1, 2000), ("n", 3, "", 1200, 2, 99_000)], kind).coalesce(1).write.parquet(source)
    spark.createDataFrame([("late", 4, "", 5000, 3, 99_000)], kind).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("later", 5, "", 6000, 3, 99_000)], kind).coalesce(1).write.mode("append").parquet(source)
    stream = live.read_log(spark, source, spark.createDataFrame([], kind).schema, 1)
    out = f"file://{tmp_path}/out"
    q = live.lease_expiry(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r.lease_id, r.key, r.expired_at_ms) for r in spark.read.parquet(out).select(F.col("lease_id"), "key", "expired_at_ms").collect())
    assert got == [(1, "m1", 2000), (1, "m2", 2000)]
