"""Behaviours of views, scans, index, mutations and leases on literal rows."""

import pytest
from pyspark.sql import functions as F

from revlake.operators import compact, index, lease, mutate, scan, views, watch
from revlake.plans import keys
from revlake.sources import changelog as cl

LOG = "key string, rev long, value string"
FULL = "key string, rev long, value string, created_at_ms long, lease_id long, lease_expires_at_ms long, tx_id long, sst_id long"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def log(spark, *entries):
    return spark.createDataFrame(list(entries), LOG)


def test_merge_later_run_wins_ties(spark):
    runs = [log(spark, ("a", None, "1"), ("b", None, "2")), log(spark, ("b", None, "3"), ("c", None, "4")), log(spark, ("d", None, "5"))]
    assert rows(views.kway_merge(runs), "key", "value") == [("a", "1"), ("b", "3"), ("c", "4"), ("d", "5")]
    tie = [log(spark, ("x", 5, "left")), log(spark, ("x", 5, "right"))]
    assert rows(views.kway_merge(tie), "value", "candidates") == [("right", 1)]


def test_as_of_and_deletes(spark):
    changes = log(spark, ("m", 1, "r1"), ("m", 2, "r2"), ("m", 3, "r3"), ("s", 4, "a"), ("s", 5, "b"), ("s", 6, None), ("e", 7, ""))
    for rev in (1, 2, 3):
        assert rows(views.get(changes, "m", rev), "value") == [(f"r{rev}",)]
    assert rows(views.as_of(changes, 5), "key", "value") == [("m", "r3"), ("s", "b")]
    assert rows(views.latest(changes), "key") == [("e",), ("m",)]  # an empty value is live
    assert ("s", None) in rows(views.latest(changes, True), "key", "value")
    assert rows(views.asof_multi(changes, changes.sparkSession.createDataFrame([("s", 5), ("s", 3), ("m", 9)], "key string, at_rev long")), "key", "at_rev", "value") == [("m", 9, "r3"), ("s", 3, None), ("s", 5, "b")]


def test_as_of_greatest_revision_is_latest(spark):
    changes = spark.range(200).select(F.concat(F.lit("k"), F.col("id") * 7 % 13).alias("key"), F.col("id").alias("rev"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("value"))
    assert rows(views.as_of(changes, 10**9), "key", "rev") == rows(views.latest(changes), "key", "rev")


@pytest.mark.parametrize(
    ("kind", "pattern", "expected"),
    [
        ("exact", "a.b", ["a.b"]), ("prefix", "a", ["a.b", "axb"]), ("suffix", "b", ["a.b", "axb"]), ("contains", "xb", ["axb"]), ("regex", "x", ["axb"]), ("regex", "(", []),
        ("fuzzy", "ab", ["a.b", "axb"]), ("fuzzy", "ba", []), ("fuzzy", "", ["a.b", "axb", "é"]), ("glob", "a.?", ["a.b"]), ("glob", "*", ["a.b", "axb", "é"]), ("all", None, ["a.b", "axb", "é"]),
    ],
)
def test_predicates(spark, kind, pattern, expected):
    view = spark.createDataFrame([("a.b",), ("axb",), ("é",)], "key string")
    assert [r[0] for r in rows(view.filter(scan.matches(kind, pattern)), "key")] == expected


def test_paging_and_exact(spark):
    view = log(spark, *[(f"k{i}", i, str(i)) for i in range(10)])
    assert [r.key for r in scan.page(view, 2, 3).collect()] == ["k2", "k3", "k4"]
    assert scan.page(view, 0, 0).count() == 0
    assert rows(scan.scan_exact(view, "none"), "key", "value") == [("none", None)]


def test_prefix_bounds():
    assert keys.prefix_end(b"ab") == b"ac"
    assert keys.prefix_end(b"a\xff") == b"b"
    assert keys.prefix_end(b"\xff") is None
    assert keys.lex_next(b"a") == b"a\0"


def test_index_equals_plain_contains(spark):
    view = spark.createDataFrame([("",), ("a",), ("abc",), ("abcd",), ("xabcabc",)], "key string")
    grams = {r.key: r.g for r in view.select("key", index.grams("key").alias("g")).collect()}
    assert grams[""] == [""] and grams["abc"] == ["abc"] and grams["abcd"] == ["abc", "bcd"]
    for pattern in ("b", "abc", "bcab", "zzz"):
        plain = rows(view.filter(F.col("key").contains(pattern)), "key")
        assert rows(index.contains(index.postings(view), view, pattern), "key") == plain
    assert [r.key for r in index.complete(view, "abc", 2).collect()] == ["abc", "abcd"]


def test_cas_accepts_one_winner(spark):
    attempts = spark.createDataFrame([(i, "c", None) for i in range(10)] + [(20, "x", None), (21, "x", 20), (22, "x", 21)], "seq long, key string, expected_rev long")
    out = mutate.cas_fold(attempts).collect()
    assert sum(r.ok for r in out if r.key == "c") == 1
    assert [r.ok for r in sorted((r for r in out if r.key == "x"), key=lambda r: r.seq)] == [True, False, True]


def test_bulk_commit_and_abort(spark):
    empty = spark.createDataFrame([], LOG)
    one = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],)], "entries array<struct<key:string,value:string>>")
    assert rows(views.latest(mutate.bulk(empty, one, 10, 1)), "key", "rev", "value") == [("a", 13, "3"), ("b", 12, "2")]
    ops = spark.createDataFrame([("x", 1, "v", 7), ("y", 2, "w", 8)], LOG + ", tx_id long")
    assert rows(mutate.commit(ops.limit(0), ops, spark.createDataFrame([(8,)], "tx_id long")), "key") == [("y",)]


def test_wal_inherits_from_transaction(spark):
    op = [("er1", None, 5, None, None, None), ("er2", None, 6, None, 9, None)]
    records = spark.createDataFrame([(True, None, None, None, 100, 3, 200, op), (None, "k", "v", 7, 101, None, None, None)], cl.WAL.simpleString().removeprefix("struct<").removesuffix(">"))
    out = {r.key: r for r in cl.flatten_wal(records).collect()}
    assert out["er1"].lease_id == 3 and out["er2"].lease_id == 9 and out["k"].lease_id is None and out["er1"].lease_expires_at_ms == 200


def full(spark, entries):
    return spark.createDataFrame([(k, r, v, r, l, e, r, 0) for k, r, v, l, e in entries], FULL)


def test_lease_follows_last_put_with_one(spark):
    changes = full(spark, [("k", 1, "a", 1, 100), ("k", 2, "b", None, None), ("k", 3, "c", 2, 200), ("d", 4, "x", 1, 100), ("d", 5, None, None, None)])
    assert rows(lease.effective(changes), "key", "lease_id") == [("k", 2)]
    assert rows(lease.effective(changes.filter("rev < 3")), "key", "lease_id") == [("k", 1)]
    assert rows(lease.expired_keys(changes, 200), "key") == [("k",)]  # inclusive
    assert rows(lease.expired_keys(changes, 199), "key") == []
    assert rows(lease.revoke(changes, 2, True), "key") == [] and rows(lease.revoke(changes, 2), "key") == [("k",)]
    assert rows(lease.eviction_ops(changes, 200, 50), "key", "rev", "value") == [("k", 51, None)]


@pytest.mark.parametrize(("policy", "expected"), [("create", (101, False)), ("ignore", (None, False)), ("throw", (None, True))])
def test_unknown_lease_policies(spark, policy, expected):
    puts = spark.createDataFrame([(1, "a", 1), (2, "b", 77)], "seq long, key string, lease_id long")
    known = spark.createDataFrame([(1,)], "lease_id long")
    out = {r.key: (r.lease_id, r.error) for r in lease.resolve(puts, known, policy, 100, 0).collect()}
    assert out == {"a": (1, False), "b": expected}


def test_new_leases_are_numbered_by_segments(spark):
    n = 60_000
    puts = spark.range(n).selectExpr("id * 997 % 60000 as seq", "concat('k', id) as key").selectExpr("seq", "key", "if(seq % 3 = 0, null, if(seq % 3 = 1, 1L, 77L)) as lease_id")
    made = lease.resolve(puts, spark.createDataFrame([(1,)], "lease_id long"), "create", 100, 0)
    assert "windowspecdefinition(seq" not in made._jdf.queryExecution().analyzed().toString()  # no task ranks all puts
    out = {r.seq: r.lease_id for r in made.collect()}
    assert out == {k: (None, 1, 100 + k // 3 + 1)[k % 3] for k in range(n)}
    assert [r["rank"] for r in lease.ranked(puts.limit(500), "seq", 7, 3).orderBy("seq").collect()] == list(range(1, 501))
    odd = spark.createDataFrame([(None, "n"), (-12, "a"), (5, "c"), (-3, "b"), (10**12, "d")], "seq long, key string")
    assert {r.key: r["rank"] for r in lease.ranked(odd, "seq", 7, 3).collect()} == {"n": 1, "a": 2, "b": 3, "c": 4, "d": 5}


MERGE = LOG + ", created_at_src long"


@pytest.mark.parametrize(
    ("entries", "options", "expected"),
    [
        ([("c", 1, "v1", 0), ("c", 2, "v2", 0), ("c", 3, None, 0)], dict(now=1000, retention_ms=1, promote=True), [("c", 2, "v2")]),
        ([("k", 1, None, 0)], dict(now=3_600_000, retention_ms=1000), []),
        ([("k", 1, None, 3_600_000)], dict(now=3_600_000, retention_ms=1000), [("k", 1, None)]),
        ([("z", 1, None, None)], dict(now=10, retention_ms=1), [("z", 1, None)]),
        ([("k", 1, None, 0)], dict(now=10**9, retention_ms=1, active_rev=1), [("k", 1, None)]),
    ],
)
def test_tombstones_in_merges(spark, entries, options, expected):
    assert rows(compact.merge(spark.createDataFrame(entries, MERGE), **options), "key", "rev", "value") == expected


def test_merge_keeps_what_snapshots_need(spark):
    changes = log(spark, ("a", 1, "1"), ("a", 2, "2"), ("a", 3, "3"), ("b", 1, "1"))
    kept = compact.merge_history(changes, 2)
    assert rows(kept, "key", "rev") == [("a", 2), ("a", 3), ("b", 1)]
    for rev in (2, 3):
        assert rows(views.as_of(kept, rev), "key", "rev") == rows(views.as_of(changes, rev), "key", "rev")


FILES = "file string, level long, min_key string, max_key string, size long, entries long, created_at_ms long"


def test_pickers(spark):
    zero = [(f"z{i}", 0, f"k{i}", f"k{i}", 2000, 1, 0) for i in range(5)]
    one = [("o1", 1, "k1", "k2", 500, 1, 0), ("o2", 1, "k2", "k3", 700, 1, 0), ("o3", 1, "x", "y", 100, 1, 0)]
    files = spark.createDataFrame(zero + one, FILES)
    assert compact.pick_level0(files, 10_000).count() == 0
    assert {r.file for r in compact.pick_level0(files, 9000).collect()} == {"z0", "z1", "z2", "z3", "z4", "o1", "o2"}
    two = spark.createDataFrame([("n1", 2, "k1", "k3", 1, 1, 0)], FILES)
    picked = compact.pick_by_overlap(files.union(two), 1, 700).orderBy("place").collect()
    assert [(r.file, r.overlap) for r in picked] == [("o1", 1), ("o2", 1)]  # overlap over size first
    assert rows(compact.pick_window(files, 1, 600, 2), "first_file", "n_files", "total") == [("o2", 1, 700)]
    assert rows(compact.promotable(files, 1), "file") == [("o1",), ("o2",), ("o3",)]


def test_split_never_exceeds_limit(spark):
    changes = spark.range(100).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("key"), F.col("id").alias("rev"), F.repeat(F.lit("v"), (F.col("id") % 40).cast("int")).alias("value"), F.lit(0).alias("g"))
    parts = compact.split_by_size(changes, "g", 400).collect()
    assert all(p.size <= 400 for p in parts) and sum(p.entries for p in parts) == 100


def test_watch(spark):
    subs = spark.createDataFrame([(1, "exact", "k1", True, None), (2, "prefix", "p", False, None), (3, "suffix", "z", False, None), (4, "contains", "mid", False, None), (5, "all", None, False, 2)], "id long, type string, pattern string, once boolean, last_seen_rev long")
    changes = log(spark, ("k1", 1, ""), ("p_hello", 2, ""), ("my_mid_key", 3, ""), ("endz", 4, ""), ("k1", 5, ""))
    got = rows(watch.deliveries(changes, subs), "id", "rev")
    assert got == [(1, 1), (2, 2), (3, 4), (4, 3), (5, 1), (5, 2), (5, 3), (5, 4), (5, 5)]
    assert (5, 2) not in rows(watch.resume(changes, subs), "id", "rev")
    assert 1 not in [r.id for r in watch.export(changes, subs).collect()]
    whole, cut = rows(watch.replay(changes, 1), "rev"), [r for lo in (1, 3) for r in rows(watch.replay(changes.filter(F.col("rev") <= (3 if lo == 1 else 9)), lo), "rev")]
    assert whole == cut
