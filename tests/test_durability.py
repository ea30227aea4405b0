"""Store, log segments, compaction, filters, sinks and the shell under damage and concurrency."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revlake import __main__ as shell
from revlake import queries
from revlake.operators import bloom, compact, mutate, views, watch
from revlake.sources import wal
from revlake.sources.store import Store
from revlake.streaming import sinks

LOG = "key string, rev bigint, value string"
SUBS = "id long, type string, pattern string, once boolean, last_seen_rev long"


def rows(spark, n, lo=0, keys=50):
    return spark.range(lo, lo + n).select(F.format_string("k%04d", F.col("id") % keys).alias("key"), (F.col("id") + 1).alias("rev"), F.when(F.col("id") % 9 != 4, F.col("id").cast("string")).alias("value"))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/db", StructType.fromDDL(LOG), level_base=512)


def state(store):
    return sorted(map(tuple, views.latest(store.read(), True).select("key", "rev", "value").collect()))


def test_concurrent_flushes_keep_both(spark, store):
    threads = [threading.Thread(target=lambda k=k: store.flush(rows(spark, 20, 20 * k))) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.read().count() == 80 and len(store.batches()) == 4 and store.max_rev() == 80


def test_a_manifest_that_is_being_written_is_passed_over(spark, store, tmp_path):
    store.flush(rows(spark, 10))
    (tmp_path / "db/manifest/000000000002.json").write_text('[{"file": "batch')
    assert store.read().count() == 10


def test_levels_are_compacted_to_their_targets(spark, store):
    for k in range(6):
        store.flush(rows(spark, 60, 60 * k))
    before = state(store)
    figures = store.compact_levels(limit=600)
    assert state(store) == before and figures["steps"] >= 1 and figures["files_created"] > 1 and figures["bytes_written"] > 0
    levels = {}
    for r in store.runs():
        levels.setdefault(r["level"], []).append(r)
    for level, runs in levels.items():
        assert sum(r["size"] for r in runs) <= store.level_base * compact.LEVEL_FACTOR**level
        runs.sort(key=lambda r: r["min_key"])
        assert level == 0 or all(a["max_key"] < b["min_key"] for a, b in zip(runs, runs[1:]))
    assert store.compact_levels()["steps"] == 0


def test_small_runs_are_small_files_cut_by_what_is_kept(spark, store, tmp_path):
    for k in range(2):
        store.flush(rows(spark, 300, 300 * k))
    before = state(store)
    figures = store.compact_levels(limit=600)
    assert state(store) == before and figures["files_created"] <= 2 * (sum(r["size"] for r in store.runs()) // 600 + 1)
    assert max((tmp_path / "db" / r["file"]).stat().st_size for r in store.runs()) < 20_000


def test_compaction_goes_on_until_every_level_is_within_its_target(spark, tmp_path, monkeypatch):
    n, made, store_of = 30_000, [], queries.store_of
    events = spark.range(n).select(F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), (F.col("id") % 6000).alias("user_id"), F.concat(F.lit("t"), F.expr("id div 6000")).alias("event_type"), F.lit("{}").alias("props"))
    events.write.parquet(f"file://{tmp_path}/events.parquet")
    monkeypatch.setattr(queries, "store_of", lambda *a, **k: made.append(store_of(*a, **k)) or made[0])
    assert queries.store_compacted(spark, f"file://{tmp_path}").count() == n
    sizes = {}
    for r in made[0].runs():
        sizes[r["level"]] = sizes.get(r["level"], 0) + r["size"]
    assert all(size <= 1024 * compact.LEVEL_FACTOR**level for level, size in sizes.items()) and made[0].read().count() == n


def test_history_for_snapshots_survives_compaction(spark, store):
    for k in range(3):
        store.flush(rows(spark, 100, 100 * k))
    old = sorted(map(tuple, views.as_of(store.read(), 150).collect()))
    store.compact(active_rev=150)
    assert sorted(map(tuple, views.as_of(store.read(), 150).collect())) == old and store.read().count() < 300


def test_background_compaction(spark, store):
    store.flush(rows(spark, 200))
    seen = []
    stop = store.background(0.05, seen.append)
    end = time.time() + 60
    while not any(s.get("steps") for s in seen) and time.time() < end:
        time.sleep(0.1)
    stop()
    assert any(s.get("steps") for s in seen) and {r["level"] for r in store.runs()} != {0}


def test_damage_is_found_and_made_good(spark, store, tmp_path):
    store.flush(rows(spark, 100))
    store.flush(rows(spark, 100, 100))
    before, log = state(store), rows(spark, 200)
    assert store.damaged() == []
    one, two = sorted(store.runs(), key=lambda r: r["file"])[:: len(store.runs()) - 1]
    (tmp_path / "db" / one["file"]).write_bytes(b"nonsense")
    (tmp_path / "db" / two["file"]).unlink()
    assert {r["file"] for r in store.damaged()} == {one["file"], two["file"]}
    assert store.repair(log) == 2 and store.damaged() == [] and state(store) == before
    assert len([p for p in (tmp_path / "db/quarantine").iterdir() if not p.name.startswith(".")]) == 1
    (tmp_path / "db" / store.runs()[0]["file"]).write_bytes(b"")
    assert store.repair() == 1 and store.damaged() == []  # without a log it is put aside


def test_point_reads_open_few_files(spark, store):
    store.flush(rows(spark, 400).repartition(1))
    store.compact_levels(limit=600)
    assert len(store.files("k0003", "k0003\0")) < len(store.files()) and len(store.get("k0003").inputFiles()) < len(store.files())
    assert [r.key for r in store.get("k0003").collect()] == ["k0003"] and store.get("nothing").count() == 0
    assert sorted(r.key for r in store.contains(store.build_index(), "k001").collect()) == [f"k001{i}" for i in range(10)]


def test_segments_round_trip_and_torn_tail(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log = rows(spark, 90).select(*LOG_FIELDS(rows(spark, 1)), *[F.lit(None).cast("bigint").alias(c) for c in ("created_at_ms", "lease_id", "lease_expires_at_ms")])
    wal.append(log, path, 40)
    want = sorted(map(tuple, log.select("key", "rev", "value").collect()))
    got = lambda **k: sorted(map(tuple, wal.read(spark, path, **k).select("key", "rev", "value").collect()))
    assert got() == want and got(from_rev=50) == [w for w in want if w[1] >= 50]
    assert {r.segment: r.lines for r in wal.inspect(spark, path).collect()} == {1: 40, 41: 40, 81: 10}
    part = next(p for p in (tmp_path / f"log/segment-{41:020d}").rglob("part-*"))
    lines = part.read_text().splitlines()
    part.write_text("\n".join(lines[:25]) + "\n" + lines[25][:-4])  # torn within a line, the rest lost
    (part.parent / f".{part.name}.crc").unlink()
    assert [w[1] for w in sorted(got(), key=lambda w: w[1])] == [*range(1, 66), *range(81, 91)]
    before = got()
    assert wal.repair(spark, path) == 1 and wal.repair(spark, path) == 0 and got() == before
    assert wal.truncate(spark, path, 80) == 2 and [w[1] for w in sorted(got(), key=lambda w: w[1])] == list(range(81, 91))
    assert wal.read(spark, f"file://{tmp_path}/none").count() == 0


def test_many_segments_are_mended_in_a_few_jobs(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log = rows(spark, 400).select("key", "rev", "value", *[F.lit(None).cast("bigint").alias(c) for c in ("created_at_ms", "lease_id", "lease_expires_at_ms")])
    wal.append(log, path, 10)
    for first, keep in ((11, 0), (201, 4)):
        part = next(p for p in (tmp_path / f"log/segment-{first:020d}").rglob("part-*"))
        lines = part.read_text().splitlines()
        part.write_text("\n".join(lines[:keep] + [x[:-3] for x in lines[keep:]]) + "\n")
        (part.parent / f".{part.name}.crc").unlink()
    spark.sparkContext.setJobGroup("mending", "")
    assert wal.repair(spark, path) == 2 and wal.repair(spark, path) == 0
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("mending"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 30
    assert sorted(r.rev for r in wal.read(spark, path).collect()) == [*range(1, 11), *range(21, 205), *range(211, 401)]
    assert wal.inspect(spark, path).count() == 39


def LOG_FIELDS(frame):
    return frame.columns


@pytest.mark.parametrize("codec", ["gzip", "snappy"])
def test_compressed_segments(spark, tmp_path, codec):
    path = f"file://{tmp_path}/log"
    log = rows(spark, 30).withColumns({c: F.lit(None).cast("bigint") for c in ("created_at_ms", "lease_id", "lease_expires_at_ms")})
    wal.append(log, path, 100, codec)
    assert wal.read(spark, path).count() == 30


def test_bloom_filters(spark):
    keys = spark.range(3000).select((F.col("id") % 3).alias("run"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    filters = bloom.build(keys)
    assert bloom.probe(filters, keys).count() == 3000  # no false negatives
    absent = spark.range(3000).select((F.col("id") % 3).alias("run"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("key"))
    assert bloom.probe(filters, absent).count() < 0.06 * 3000


def test_folds_are_linear_in_a_hot_key(spark):
    n = 300_000
    attempts = spark.range(n).select(F.lit("hot").alias("key"), F.col("id").alias("seq"), F.when(F.col("id") > 0, F.when(F.col("id") % 3 == 2, F.lit(-1)).otherwise(F.col("id") - F.when(F.col("id") % 3 == 0, 1).otherwise(0))).alias("expected_rev"))
    began = time.time()
    assert mutate.cas_fold(attempts).filter("ok").count() > 0
    entries = spark.range(n).select(F.lit("one").alias("of"), F.format_string("k%07d", "id").alias("key"), F.col("id").alias("rev"), F.lit("v" * 20).alias("value"))
    parts = compact.split_by_size(entries, "of", 4096).agg(F.sum("entries"), F.max("size"), F.countDistinct("part")).head()
    assert parts[0] == n and parts[1] <= 4096 and parts[2] > 1000 and time.time() - began < 60


def test_runs_across_segments(spark):
    revs = [*range(5, 31), *range(35, 41), 50, *range(59, 61)]
    log = spark.createDataFrame([("a", r) for r in revs] + [("b", 31)], "t string, rev long")
    got = sorted(tuple(r) for r in mutate.rev_runs(log, "t", segment=10).collect())
    assert got == [("a", 5, 30, 26), ("a", 35, 40, 6), ("a", 50, 50, 1), ("a", 59, 60, 2), ("b", 31, 31, 1)]


def test_matching_equals_brute_force_without_nested_loops(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abé"), n))
    events = [(word(rng.integers(0, 7)), i, str(i)) for i in range(120)]
    kinds = ("all", "exact", "prefix", "suffix", "contains", "unknown")
    subs = [(i, kinds[i % 6], word(rng.integers(0, 5)), False, None) for i in range(90)] + [(100, "contains", None, False, None)]
    log, table = spark.createDataFrame(events, LOG), spark.createDataFrame(subs, SUBS)
    test = {"all": lambda k, p: True, "exact": lambda k, p: k == p, "prefix": str.startswith, "suffix": str.endswith, "contains": lambda k, p: p in k, "unknown": lambda k, p: False}
    want = sorted((s[0], e[1]) for s in subs for e in events if s[2] is not None and test[s[1]](e[0], s[2]))
    found = watch.deliveries(log, table)
    assert sorted((r.id, r.rev) for r in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert watch.deliveries(log, table.limit(0)).count() == 0


def test_matching_never_broadcasts_events(spark, tmp_path, monkeypatch):
    rows(spark, 400).write.parquet(f"file://{tmp_path}/events")
    log = spark.read.parquet(f"file://{tmp_path}/events")
    subs = spark.createDataFrame([(1, "all", None, False, None), (2, "prefix", "k00", False, 7), (3, "contains", "01", True, None)], SUBS)
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    few = watch.deliveries(log, subs)
    want = sorted(tuple(r) for r in few.collect())
    assert len(want) == 801 and "BuildRight" in plan(few) and "BuildLeft" not in plan(few)
    monkeypatch.setattr(watch, "BROADCAST_BYTES", 0)
    many = watch.deliveries(log, subs)
    assert "SortMergeJoin" in plan(many) and "BroadcastHashJoin" not in plan(many) and sorted(tuple(r) for r in many.collect()) == want


def test_sinks_and_registry(spark, tmp_path):
    found = spark.createDataFrame([(1, 10, "a", "x"), (2, 11, "b", None), (1, 10, "a", "x")], "id long, rev long, key string, value string")
    memory, files = sinks.sink("memory"), sinks.sink("file", path=f"file://{tmp_path}/out")
    for _ in range(2):  # a batch that runs again
        memory(found, 0)
        files(found, 0)
    assert memory.rows == {(1, 10): ("a", "x"), (2, 11): ("b", None)}
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2
    got, refuse = [], [2]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            refuse[0] -= 1
            if refuse[0] < 0:
                got.extend(json.loads(body))
            self.send_response(503 if refuse[0] >= 0 else 200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    sinks.sink("http", url=f"http://127.0.0.1:{server.server_port}/", batch=1)(found.dropDuplicates().coalesce(1), 7)
    server.shutdown()
    assert sorted((r["id"], r["rev"], r["batch"]) for r in got) == [(1, 10, 7), (2, 11, 7)]
    one, two = sinks.Memory(), sinks.Memory()
    registry = sinks.Registry().attach({1: one, 2: two})
    registry.detach(2)
    registry(found, 0)
    assert list(one.rows) == [(1, 10)] and not two.rows and sinks.sink(one) is one
    table = spark.createDataFrame([(1, "all", None, False, 3), (2, "exact", "k", True, None)], SUBS)
    sinks.save(table, f"file://{tmp_path}/subs")
    assert sorted(map(tuple, sinks.load(spark, f"file://{tmp_path}/subs").collect())) == [(1, "all", None, False, 3), (2, "exact", "k", True, None)]


def test_shell(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/db"
    run = lambda *a: shell.run(spark, [path, *a])
    assert run("put", "a", "1") == {"key": "a", "rev": 1} and run("put", "ab", "2")["rev"] == 2 and run("delete", "a")["rev"] == 3
    assert [r.key for r in run("scan", "--prefix", "a").collect()] == ["ab"] and run("get", "a").count() == 0
    assert [(r.rev, r.value) for r in run("history", "a").collect()] == [(3, None), (1, "1")] and run("runs").count() == 3
    assert run("compact")["steps"] == 0 and run("vacuum") == {"deleted": 0} and run("verify") == {"damaged": []}
    assert [r.key for r in run("complete", "ab").collect()] == ["ab", "a"]
    shell.main([path, "--json", "get", "ab"])
    assert json.loads(capsys.readouterr().out)["value"] == "2"
