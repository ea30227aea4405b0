"""The registered queries over the canonical changelog, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.functions import scalars as fn
from revlake.operators import bloom, compact, index, lease, mutate, scan, views, watch
from revlake.sources import changelog as cl
from revlake.sources import wal
from revlake.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = 1_706_650_000_000
REV = 500
LEVELS = 7

#: The changelog, and what most queries start from, in SQL.
PRELUDE = """WITH RECURSIVE log AS (
  SELECT event_type || ':' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS key, event_id + 1 AS rev,
    CASE WHEN event_id % 7 <> 3 THEN props END AS value, epoch_us(ts) // 1000 AS created_at_ms,
    CASE WHEN event_id % 5 = 0 THEN user_id % 16 + 1 END AS lease_id,
    CASE WHEN event_id % 5 = 0 THEN epoch_us(ts) // 1000 + 21600000 END AS lease_expires_at_ms,
    event_id // 4 AS tx_id, event_id // 250 AS sst_id
  FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rev DESC) AS version FROM log),
newest AS (SELECT * FROM ranked WHERE version = 1),
live AS (SELECT * FROM newest WHERE value IS NOT NULL),
past AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rev DESC) AS v FROM log WHERE rev <= 500) WHERE v = 1),
wal AS (SELECT *, CAST(sum(24 + length(key) + coalesce(length(value), 0)) OVER (ORDER BY rev) AS BIGINT) AS wal_end, 24 + length(key) + coalesce(length(value), 0) AS bytes FROM log),
gone AS (SELECT key, max(rev) AS gone FROM log WHERE value IS NULL GROUP BY key),
held AS (SELECT key, lease_id, lease_expires_at_ms FROM (
  SELECT l.*, row_number() OVER (PARTITION BY l.key ORDER BY l.rev DESC) AS v FROM log l LEFT JOIN gone g ON l.key = g.key
  WHERE l.value IS NOT NULL AND l.lease_id IS NOT NULL AND (g.gone IS NULL OR l.rev > g.gone)) WHERE v = 1
  AND key IN (SELECT key FROM log)),
granted AS (SELECT lease_id, max(lease_expires_at_ms) AS expires_at_ms FROM log WHERE lease_id IS NOT NULL GROUP BY lease_id),
sized AS (SELECT *, 4 + strlen(key) + 4 + coalesce(strlen(value), 0) + CASE WHEN rev < 128 THEN 1 WHEN rev < 16384 THEN 2 WHEN rev < 2097152 THEN 3 WHEN rev < 268435456 THEN 4 ELSE 5 END + 2 AS size FROM log),
files AS (SELECT file, level, min(key) AS min_key, max(key) AS max_key, CAST(sum(size) AS BIGINT) AS size, count(*) AS entries, max(created_at_ms) AS created_at_ms
  FROM (SELECT *, CAST(rev % 3 AS BIGINT) AS level, split_part(key, ':', 1) || '-' || CAST(CAST((CAST(split_part(key, ':', 2) AS BIGINT) + 25 * (rev % 3)) // 50 AS BIGINT) AS VARCHAR) || '-' || CAST(rev % 3 AS VARCHAR) AS file FROM sized) GROUP BY file, level),
subs(id, type, pattern, once, last_seen_rev) AS (VALUES (1, 'exact', 'click:0007', true, NULL), (2, 'prefix', 'view:', false, 400), (3, 'suffix', '7', false, 900), (4, 'contains', 'k:00', false, NULL), (5, 'all', NULL, false, 950), (6, 'prefix', 'nothing:', true, 10))
"""
SUBS = [(1, "exact", "click:0007", True, None), (2, "prefix", "view:", False, 400), (3, "suffix", "7", False, 900), (4, "contains", "k:00", False, None), (5, "all", None, False, 950), (6, "prefix", "nothing:", True, 10)]


def query(sql: str | None = None, prelude: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (PRELUDE if prelude else "") + sql
        return f

    return register


def log_of(spark: SparkSession, sf: str) -> DataFrame:
    return cl.changelog(spark, sf)


def folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="revlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/revlake-{uuid.uuid4().hex}"


def store_of(spark: SparkSession, sf: str, batches: int = 3, **options) -> Store:
    """The changelog as a store: so many flushes by revision."""
    log = log_of(spark, sf)
    store = Store(spark, folder(spark), log.schema, **options)
    for k in range(batches):
        store.flush(log.filter(F.expr(f"rev div 250 % {batches} = {k}")))
    return store


def subs_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBS, "id long, type string, pattern string, once boolean, last_seen_rev long")


def key_rev_value(df: DataFrame) -> DataFrame:
    return df.select("key", "rev", "value")


def files_of(spark: SparkSession, sf: str) -> DataFrame:
    level = F.col("rev") % 3
    file = F.concat_ws("-", F.split("key", ":")[0], F.expr("(cast(split(key, ':')[1] as bigint) + 25 * (rev % 3)) div 50").cast("string"), level.cast("string"))
    return compact.manifest(log_of(spark, sf).withColumn("file", file), "file", level)


# Point lookups and snapshots ------------------------------------------------------

@query("SELECT key, rev, value FROM live WHERE key = 'click:0007'")
def kv_get(s, d):
    return key_rev_value(views.get(log_of(s, d), "click:0007"))


@query("SELECT n.key, n.rev, n.value, n.created_at_ms, n.lease_id, n.tx_id, n.sst_id, w.wal_end FROM newest n JOIN wal w ON n.rev = w.rev WHERE n.key = 'view:0003'")
def kv_get_with_meta(s, d):
    return views.newest(cl.with_offsets(log_of(s, d)).filter("key = 'view:0003'")).select("key", "rev", "value", "created_at_ms", "lease_id", "tx_id", "sst_id", "wal_end")


@query("SELECT key, rev, value FROM past WHERE key = 'click:0007' AND value IS NOT NULL")
def kv_get_at_revision(s, d):
    return key_rev_value(views.get(log_of(s, d), "click:0007", REV))


PROBES = "(SELECT DISTINCT 'click:' || lpad(CAST(c_custkey % 200 AS VARCHAR), 4, '0') AS key FROM customer)"


def probe_keys(s, d):
    return cl.table(s, d, "customer").select(F.concat(F.lit("click:"), F.lpad((F.col("c_custkey") % 200).cast("string"), 4, "0")).alias("key")).distinct()


@query(f"SELECT p.key, l.rev, l.value FROM {PROBES} p LEFT JOIN live l ON p.key = l.key")
def kv_multi_get(s, d):
    return views.multi_get(log_of(s, d), probe_keys(s, d))


@query(f"SELECT key, at_rev, rev, value FROM (SELECT p.key, CAST(1 + a.x * 300 AS BIGINT) AS at_rev, l.rev, l.value, row_number() OVER (PARTITION BY p.key, a.x ORDER BY l.rev DESC NULLS LAST) AS v FROM {PROBES} p, (VALUES (0), (1), (2)) a(x) LEFT JOIN log l ON l.key = p.key AND l.rev <= 1 + a.x * 300) WHERE v = 1")
def kv_asof_multi(s, d):
    probes = probe_keys(s, d).select("key", F.explode(F.array(*[F.lit(1 + x * 300).cast("long") for x in range(3)])).alias("at_rev"))
    return views.asof_multi(log_of(s, d), probes)


@query("SELECT key, rev, value FROM live WHERE key LIKE 'click:%'")
def kv_range_prefix(s, d):
    return key_rev_value(views.latest(scan.prefix_range(log_of(s, d), "click:")))


@query("SELECT key, rev, value FROM live WHERE key LIKE 'click:%' ORDER BY key LIMIT 10 OFFSET 5")
def kv_range_page(s, d):
    return key_rev_value(scan.page(views.latest(scan.prefix_range(log_of(s, d), "click:")), 5, 10))


@query("SELECT key, rev, value FROM live WHERE key >= 'cart:0005' AND key < 'click:0010'")
def kv_range_half_open(s, d):
    return key_rev_value(views.latest(scan.key_range(log_of(s, d), "cart:0005", "click:0010")))


@query("SELECT key, rev, value FROM newest ORDER BY key")
def kv_scan_all(s, d):
    return key_rev_value(views.latest(log_of(s, d), True)).orderBy("key")


@query("SELECT key, rev, value FROM live")
def kv_snapshot_latest(s, d):
    return key_rev_value(views.latest(log_of(s, d)))


@query("SELECT key, rev, value FROM past WHERE value IS NOT NULL")
def kv_snapshot_at_rev(s, d):
    return key_rev_value(views.as_of(log_of(s, d), REV))


@query("SELECT key, rev, value, CAST(version AS BIGINT) AS version FROM ranked")
def key_history(s, d):
    return views.history(log_of(s, d)).select("key", "rev", "value", F.col("version").cast("long").alias("version"))


@query("SELECT key, rev, lead(rev) OVER (PARTITION BY key ORDER BY rev) AS next_rev FROM log")
def version_intervals(s, d):
    return views.intervals(log_of(s, d)).select("key", "rev", "next_rev")


@query("SELECT key, rev, value, CAST(rev % 3 AS BIGINT) AS run_idx, n - 1 AS candidates FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM ranked) WHERE version = 1")
def kway_merge(s, d):
    log = key_rev_value(log_of(s, d))
    return views.kway_merge([log.filter(F.col("rev") % 3 == k) for k in range(3)]).withColumn("run_idx", F.col("run_idx").cast("long"))


@query("SELECT l.key, l.rev, l.value, CAST(l.rev % 3 AS BIGINT) AS run_idx FROM ranked l WHERE version > 1")
def kway_candidates(s, d):
    log = key_rev_value(log_of(s, d))
    return views.candidates([log.filter(F.col("rev") % 3 == k) for k in range(3)]).withColumn("run_idx", F.col("run_idx").cast("long"))


@query("SELECT coalesce(a.key, b.key) AS key, a.value AS old_value, b.value AS new_value FROM (SELECT * FROM past WHERE value IS NOT NULL) a FULL JOIN live b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value")
def snapshot_diff(s, d):
    return views.snapshot_diff(log_of(s, d), REV, 10**12)


# Scans -----------------------------------------------------------------------------

@query("SELECT x.key, l.value FROM (VALUES ('click:9999')) x(key) LEFT JOIN live l ON x.key = l.key")
def scan_exact(s, d):
    return scan.scan_exact(views.get(log_of(s, d), "click:9999"), "click:9999")


def _register_scan(name: str, kind: str, pattern: str, where: str):
    def run(s, d):
        return key_rev_value(views.latest(log_of(s, d).filter(scan.matches(kind, pattern))))

    run.__name__ = name
    query(f"SELECT key, rev, value FROM live WHERE {where}")(run)


for _name, _kind, _pattern, _where in (
    ("scan_suffix", "suffix", "07", "key LIKE '%07'"),
    ("scan_contains", "contains", "k:00", "contains(key, 'k:00')"),
    ("scan_regex", "regex", "^(view|click):0[0-2]+", "regexp_matches(key, '^(view|click):0[0-2]+')"),
    ("scan_fuzzy", "fuzzy", "ck7", "regexp_matches(key, 'c.*k.*7')"),
    ("glob_match", "glob", "c*:00?7", "key LIKE 'c%:00_7'"),
    ("watch_filter_exact", "exact", "click:0007", "key = 'click:0007'"),
    ("watch_filter_prefix", "prefix", "view:", "key LIKE 'view:%'"),
    ("watch_filter_suffix", "suffix", "7", "key LIKE '%7'"),
    ("watch_filter_contains", "contains", "e:00", "contains(key, 'e:00')"),
    ("watch_filter_all", "all", "", "true"),
):
    _register_scan(_name, _kind, _pattern, _where)


@query("SELECT key, rev, value FROM live WHERE key LIKE 'c%' AND key LIKE '%7' AND contains(key, ':0') ORDER BY key LIMIT 5")
def scan_combined(s, d):
    return key_rev_value(scan.scan(views.latest(scan.prefix_range(log_of(s, d), "c")), 0, 5, prefix="c", suffix="7", contains=":0"))


@query("SELECT key FROM (SELECT DISTINCT key FROM log) ORDER BY key LIMIT 100")
def list_keys(s, d):
    return scan.page(log_of(s, d).select("key").distinct(), 0, 100)


@query("SELECT DISTINCT key FROM log")
def distinct_keys(s, d):
    return log_of(s, d).select("key").distinct()


# Trigram index -----------------------------------------------------------------------

GRAMS = "SELECT DISTINCT substring(key, i, 3) AS gram, key FROM (SELECT key, unnest(range(1, greatest(2, length(key) - 1))) AS i FROM (SELECT DISTINCT key FROM log))"


def keys_of(s, d):
    return log_of(s, d).select("key").distinct()


@query(f"SELECT gram, key, count(*) OVER (PARTITION BY gram) AS n FROM ({GRAMS})")
def ngram_index(s, d):
    return index.build(keys_of(s, d))


@query(f"SELECT gram, count(*) AS df FROM ({GRAMS}) GROUP BY gram")
def ngram_df(s, d):
    return index.postings(keys_of(s, d)).groupBy("gram").agg(F.count("*").alias("df"))


@query("SELECT DISTINCT key FROM log WHERE contains(key, 'ick:00')")
def ngram_contains(s, d):
    keys = keys_of(s, d)
    return index.contains(index.postings(keys), keys, "ick:00")


@query("SELECT key, CAST(CASE WHEN starts_with(key, 'clik:0') THEN 0 ELSE 1 END AS BIGINT) AS rank, CAST(levenshtein(key, 'clik:0') AS BIGINT) AS distance FROM (SELECT DISTINCT key FROM log) ORDER BY rank, distance, key LIMIT 50")
def levenshtein_topk(s, d):
    return index.complete(keys_of(s, d), "clik:0").withColumn("rank", F.col("rank").cast("long"))


# Mutations -----------------------------------------------------------------------------

@query("SELECT key, CAST(max(rev) AS BIGINT) AS rev, CAST(count(*) AS BIGINT) AS versions FROM (SELECT key, rev FROM log UNION ALL SELECT 'order:' || CAST(o_custkey AS VARCHAR), (SELECT max(rev) FROM log) + row_number() OVER (ORDER BY o_orderkey) FROM orders) GROUP BY key")
def apply_puts(s, d):
    log = log_of(s, d)
    ops = cl.table(s, d, "orders").select(F.concat(F.lit("order:"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("n"))
    top = log.agg(F.max("rev")).head()[0] or 0
    return mutate.puts(log, ops, top, "n").groupBy("key").agg(F.max("rev").alias("rev"), F.count("*").alias("versions"))


@query("SELECT key, rev, value FROM (VALUES ('bulk:a', 'three', 1000003), ('bulk:b', 'two', 1000002)) b(key, value, rev) UNION ALL SELECT key, rev, value FROM live")
def apply_bulk(s, d):
    rows = s.range(1).select(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("bulk:a", "one"), ("bulk:b", "two"), ("bulk:a", "three"))]).alias("entries"))
    return key_rev_value(views.latest(mutate.bulk(log_of(s, d), rows, 1_000_000, 0)))


@query("SELECT key, rev, value FROM live WHERE key NOT LIKE 'view:%'")
def apply_deletes(s, d):
    log = log_of(s, d)
    dead = log.filter(scan.matches("prefix", "view:")).groupBy("key").agg(F.min("rev").alias("n"))
    return key_rev_value(views.latest(mutate.deletes(log, dead, 10**9, "n")))


@query("SELECT a.key, a.expected_rev, n.rev AS current_rev, a.expected_rev IS NOT DISTINCT FROM n.rev AS ok FROM (SELECT key, CASE WHEN rev % 2 = 0 THEN rev END AS expected_rev FROM newest UNION ALL SELECT 'new:key', NULL) a LEFT JOIN newest n ON a.key = n.key")
def cas_check(s, d):
    log = log_of(s, d)
    attempts = views.newest(log).select("key", F.when(F.col("rev") % 2 == 0, F.col("rev")).alias("expected_rev")).union(s.range(1).select(F.lit("new:key"), F.lit(None).cast("long")))
    return mutate.cas_check(log, attempts).select("key", "expected_rev", "current_rev", "ok")


@query(""", attempts AS (SELECT key, rev - 1 AS seq, row_number() OVER (PARTITION BY key ORDER BY rev) AS i,
  CASE WHEN rev % 3 = 1 THEN lag(rev, 2) OVER (PARTITION BY key ORDER BY rev) ELSE lag(rev) OVER (PARTITION BY key ORDER BY rev) END AS expected_rev FROM log),
fold AS (SELECT key, seq, i, expected_rev IS NULL AS ok, CASE WHEN expected_rev IS NULL THEN seq + 1 END AS rev_after FROM attempts WHERE i = 1
  UNION ALL SELECT a.key, a.seq, a.i, a.expected_rev IS NOT DISTINCT FROM f.rev_after, CASE WHEN a.expected_rev IS NOT DISTINCT FROM f.rev_after THEN a.seq + 1 ELSE f.rev_after END FROM fold f JOIN attempts a ON a.key = f.key AND a.i = f.i + 1)
SELECT key, seq, ok, rev_after FROM fold""")
def cas_fold(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("rev")
    attempts = log_of(s, d).select("key", (F.col("rev") - 1).alias("seq"), F.when(F.col("rev") % 3 == 1, F.lag("rev", 2).over(w)).otherwise(F.lag("rev").over(w)).alias("expected_rev"))
    return mutate.cas_fold(attempts)


@query("SELECT key, rev, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rev DESC) AS v FROM log WHERE tx_id % 5 <> 0) WHERE v = 1 AND value IS NOT NULL")
def tx_apply(s, d):
    log = log_of(s, d)
    committed = log.select("tx_id").distinct().filter("tx_id % 5 <> 0")
    return key_rev_value(views.latest(mutate.commit(log.limit(0), log, committed)))


@query("SELECT tx_id, count(*) AS ops, min(rev) AS first_rev, max(rev) AS last_rev, count(DISTINCT key) AS n_keys FROM log GROUP BY tx_id")
def tx_summary(s, d):
    return mutate.tx_summary(log_of(s, d))


@query("SELECT key_type, min(rev) AS first_rev, max(rev) AS last_rev, count(*) AS n FROM (SELECT *, rev - row_number() OVER (PARTITION BY key_type ORDER BY rev) AS run FROM (SELECT split_part(key, ':', 1) AS key_type, rev FROM log)) GROUP BY key_type, run")
def tx_rev_runs(s, d):
    return mutate.rev_runs(log_of(s, d).select(F.split("key", ":")[0].alias("key_type"), "rev"), "key_type")


# The log as records -----------------------------------------------------------------------

@query("SELECT rev, key, wal_end - bytes AS wal_start, wal_end FROM wal")
def wal_offsets(s, d):
    return cl.with_offsets(log_of(s, d)).select("rev", "key", "wal_start", "wal_end")


@query("SELECT rev, key, wal_end FROM wal WHERE wal_end > 20000 ORDER BY wal_end")
def wal_scan_from(s, d):
    return watch.replay(cl.with_offsets(log_of(s, d)), min_offset=20_000).select("rev", "key", "wal_end").orderBy("wal_end")


@query("SELECT rev, key, value FROM log ORDER BY rev DESC")
def wal_reverse_scan(s, d):
    return log_of(s, d).select("rev", "key", "value").orderBy(F.desc("rev"))


@query("SELECT count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(count(value) AS BIGINT) AS values FROM wal")
def wal_validate_count(s, d):
    return log_of(s, d).agg(F.count("*").alias("records"), F.sum(cl.record_bytes()).alias("bytes"), F.count("value").alias("values"))


@query("SELECT key, rev, value, lease_id FROM log")
def wal_json_roundtrip(s, d):
    records = cl.to_wal(log_of(s, d)).select(F.to_json(F.struct("tx", F.transform("ops", lambda o: F.struct(o["key"].alias("key"), o["value"].alias("value"), o["rev"].alias("rev"), o["lease_id"].alias("leaseId"), o["lease_expires_at_ms"].alias("leaseExpiresAt"))).alias("ops"), "createdAt")).alias("line"))
    return cl.flatten_wal(records.select(F.from_json("line", cl.WAL).alias("r")).select("r.*")).select("key", "rev", "value", "lease_id")


@query("SELECT sst_id, max(wal_end) AS seg_end FROM wal GROUP BY sst_id HAVING max(wal_end) <= 40000")
def wal_segments_gc(s, d):
    return cl.with_offsets(log_of(s, d)).groupBy("sst_id").agg(F.max("wal_end").alias("seg_end")).filter("seg_end <= 40000")


@query("SELECT rev, key, value FROM (SELECT * FROM log WHERE tx_id % 2 = 1 ORDER BY rev DESC LIMIT 100) ORDER BY rev")
def recent_events(s, d):
    return log_of(s, d).filter("tx_id % 2 = 1").select("rev", "key", "value").orderBy(F.desc("rev")).limit(100).orderBy("rev")


@query("SELECT key, rev, value FROM live")
def recover_merge(s, d):
    log = key_rev_value(log_of(s, d))
    flushed = compact.merge(log.filter("rev <= 600").withColumn("created_at_src", F.lit(0).cast("long")))
    return views.latest(flushed.union(log.filter("rev > 500")))


@query("SELECT key, rev, value FROM newest")
def rebuild_range(s, d):
    """One run of a store is overwritten, another deleted; both are found, put aside and made again from the log."""
    store, log = store_of(s, d), log_of(s, d)
    runs = sorted(store.runs(), key=lambda r: r["file"])
    for run, content in ((runs[0], b"no longer a run"), (runs[-1], None)):
        if content is None:
            store._fs.delete(store._path(run["file"]), False)
        else:
            out = store._fs.create(store._path(run["file"]), True)
            out.write(bytearray(content))
            out.close()
    if store.repair(log) < min(2, len(runs)):
        raise ValueError("damage was not found")
    return key_rev_value(views.latest(store.read(), True))


@query("SELECT key, rev, value FROM log WHERE rev <= 1000 OR rev > 1500")
def wal_tail_repair(s, d):
    """Segments of 500 records; of one, the records from 1001 on are torn and cut off."""
    path, log = folder(s), log_of(s, d)
    wal.append(log, path, 500)
    torn = dict(wal._folders(s, path)).get(1001)
    if torn:
        lines = s.read.text(torn)
        place = F.get_json_object(F.substring("value", 10, 2**30), "$.place").cast("int")
        new = f"{path}/.torn"
        lines.select(F.when(place >= 0, F.expr("left(value, length(value) - 3)")).otherwise(F.col("value")).alias("value")).write.text(new)
        target, fs = s._jvm.org.apache.hadoop.fs.Path(torn), s._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(s._jsc.hadoopConfiguration())
        fs.delete(target, True)
        fs.rename(s._jvm.org.apache.hadoop.fs.Path(new), target)
        if wal.repair(s, path) != 1:
            raise ValueError("the torn tail was not found")
    return wal.read(s, path).select("key", "rev", "value")


@query("SELECT key, rev, value, lease_id FROM log WHERE rev > 500 AND rev >= 700")
def wal_append_truncate(s, d):
    """The log as compressed segments, the first one deleted, read from a revision."""
    path = folder(s)
    wal.append(log_of(s, d), path, 500, "gzip")
    wal.truncate(s, path, 600)
    return wal.read(s, path, 700).select("key", "rev", "value", "lease_id")


@query("SELECT CAST((rev - 1) // 500 * 500 + 1 AS BIGINT) AS segment, count(*) AS lines FROM log GROUP BY ALL")
def wal_segments(s, d):
    path = folder(s)
    wal.append(log_of(s, d), path, 500)
    return wal.inspect(s, path).select("segment", "lines")


# The store -----------------------------------------------------------------------------------

@query("SELECT key, rev, value FROM live WHERE key = 'click:0007'")
def store_get(s, d):
    return key_rev_value(store_of(s, d).get("click:0007"))


@query("SELECT key, rev, value FROM live WHERE key LIKE 'click:%'")
def store_range_prefix(s, d):
    return key_rev_value(views.latest(store_of(s, d).read("click:", "click;")))


@query("SELECT key, rev, value FROM log WHERE key >= 'cart:0005' AND key < 'click:0010'")
def store_run_iterator(s, d):
    return key_rev_value(store_of(s, d).read("cart:0005", "click:0010"))


@query("SELECT DISTINCT key FROM log WHERE contains(key, 'ick:00')")
def store_contains(s, d):
    store = store_of(s, d)
    return store.contains(store.build_index(), "ick:00")


@query("SELECT key, rev, value FROM newest")
def store_compacted(s, d):
    """Levels compacted until each is within its target: no version of a key is lost or kept twice."""
    store = store_of(s, d, level_base=1024)
    store.compact_levels(limit=4096)
    return key_rev_value(views.latest(store.read(), True))


# Leases ---------------------------------------------------------------------------------

@query("SELECT g.lease_id, g.expires_at_ms, coalesce(c.n_keys, 0) AS n_keys, h.key FROM granted g LEFT JOIN (SELECT lease_id, count(*) AS n_keys FROM held GROUP BY lease_id) c ON g.lease_id = c.lease_id LEFT JOIN held h ON g.lease_id = h.lease_id")
def lease_info(s, d):
    return lease.info(log_of(s, d))


#: Lease operations that the events stand for: most attach, some grant, renew or revoke.
LEASE_OPS = """, ops AS (SELECT rev AS seq, CASE WHEN rev % 11 = 1 THEN 'grant' WHEN rev % 11 = 5 THEN 'renew' WHEN rev % 97 = 13 THEN 'revoke' ELSE 'attach' END AS op,
  CASE WHEN rev % 11 = 1 OR rev % 11 = 5 THEN rev % 13 ELSE rev % 17 END AS lease_id, key, CASE WHEN rev % 2 = 0 THEN 0 ELSE 3600000 END AS ttl_ms, created_at_ms AS at_ms FROM log),
made AS (SELECT lease_id, min(seq) FILTER (op = 'grant') AS granted, min(seq) FILTER (op = 'revoke') AS revoked_at FROM ops GROUP BY lease_id HAVING count(*) FILTER (op = 'grant') > 0),
state AS (SELECT o.lease_id, arg_max(CASE WHEN op IN ('grant', 'renew') THEN at_ms + greatest(1, ttl_ms) END, CASE WHEN op IN ('grant', 'renew') THEN seq END) AS expires_at_ms, bool_or(m.revoked_at IS NOT NULL) AS revoked, count(DISTINCT CASE WHEN op = 'attach' THEN key END) AS n_keys
  FROM ops o JOIN made m ON o.lease_id = m.lease_id WHERE seq >= granted AND (revoked_at IS NULL OR seq <= revoked_at) GROUP BY o.lease_id)
"""


def lease_ops(s, d):
    rev = F.col("rev")
    op = F.when(rev % 11 == 1, "grant").when(rev % 11 == 5, "renew").when(rev % 97 == 13, "revoke").otherwise("attach")
    return log_of(s, d).select(rev.alias("seq"), op.alias("op"), F.when((rev % 11 == 1) | (rev % 11 == 5), rev % 13).otherwise(rev % 17).alias("lease_id"), "key", F.when(rev % 2 == 0, 0).otherwise(3_600_000).cast("long").alias("ttl_ms"), F.col("created_at_ms").alias("at_ms"))


@query(f"{LEASE_OPS} SELECT * FROM state")
def lease_operations(s, d):
    return lease.after(lease_ops(s, d))


@query(f"{LEASE_OPS} SELECT lease_id, 'grant' AS event, CAST(0 AS BIGINT) AS n_keys FROM state UNION ALL SELECT * FROM (SELECT lease_id, CASE WHEN revoked THEN 'revoke' WHEN expires_at_ms <= {NOW} AND n_keys > 0 THEN 'evict' WHEN expires_at_ms <= {NOW} THEN 'expire' END AS event, n_keys FROM state) WHERE event IS NOT NULL")
def lease_operation_events(s, d):
    return lease.operation_events(lease_ops(s, d), NOW)


@query("SELECT l.key, l.rev, l.lease_id, g.expires_at_ms FROM log l JOIN granted g ON l.lease_id = g.lease_id WHERE l.value IS NOT NULL")
def lease_keys_join(s, d):
    log = log_of(s, d)
    return log.filter("value is not null").join(lease.grants(log), "lease_id").select("key", "rev", "lease_id", "expires_at_ms")


@query("SELECT key, lease_id, lease_expires_at_ms FROM held")
def lease_effective(s, d):
    return lease.effective(log_of(s, d))


@query("SELECT g.lease_id, coalesce(r.until, g.expires_at_ms) AS expires_at_ms FROM granted g LEFT JOIN (SELECT lease_id, arg_max(created_at_ms + 7200000, created_at_ms) AS until FROM log WHERE lease_id % 2 = 0 GROUP BY lease_id) r ON g.lease_id = r.lease_id")
def lease_renewed(s, d):
    log = log_of(s, d)
    renewals = log.filter("lease_id % 2 = 0").select("lease_id", F.col("created_at_ms").alias("at_ms"), F.lit(7_200_000).alias("ttl_ms"))
    return lease.renew(lease.grants(log), renewals)


@query("SELECT key, rev, value FROM live WHERE key NOT IN (SELECT key FROM held WHERE lease_id = 3)")
def lease_revoke(s, d):
    return key_rev_value(lease.revoke(log_of(s, d), 3, True))


@query(f"SELECT h.key, h.lease_id FROM held h JOIN granted g ON h.lease_id = g.lease_id WHERE g.expires_at_ms <= {NOW}")
def lease_expired_keys(s, d):
    return lease.expired_keys(log_of(s, d), NOW)


@query(f"SELECT key, rev, value FROM live WHERE key NOT IN (SELECT h.key FROM held h JOIN granted g ON h.lease_id = g.lease_id WHERE g.expires_at_ms <= {NOW})")
def lease_evict_apply(s, d):
    return key_rev_value(lease.evict(log_of(s, d), NOW))


@query(f"SELECT lease_id, 'grant' AS event, CAST(0 AS BIGINT) AS n_keys FROM granted UNION ALL SELECT g.lease_id, CASE WHEN count(h.key) > 0 THEN 'evict' ELSE 'expire' END, count(h.key) FROM granted g LEFT JOIN held h ON g.lease_id = h.lease_id WHERE g.expires_at_ms <= {NOW} GROUP BY g.lease_id")
def lease_events(s, d):
    return lease.events(log_of(s, d), NOW)


@query("SELECT rev - 1 AS seq, key, CASE WHEN lease_id <= 8 THEN lease_id WHEN lease_id IS NOT NULL THEN 1000 + sum(CASE WHEN lease_id > 8 THEN 1 ELSE 0 END) OVER (ORDER BY rev) END::BIGINT AS lease_id, false AS error FROM log WHERE rev <= 800")
def lease_unknown_policy(s, d):
    log = log_of(s, d).filter("rev <= 800")
    known = lease.grants(log).filter("lease_id <= 8")
    return lease.resolve(log.select((F.col("rev") - 1).alias("seq"), "key", "lease_id"), known, "create", 1000, NOW)


# Runs, manifest, compaction -----------------------------------------------------------------

@query("SELECT level, file, min_key, max_key, size FROM files WHERE level = 1 ORDER BY file")
def manifest_by_level(s, d):
    return files_of(s, d).filter("level = 1").select("level", "file", "min_key", "max_key", "size").orderBy("file")


@query("SELECT file, level, size FROM files WHERE level <> 0 UNION ALL SELECT 'merged-0', 1, CAST(sum(size) AS BIGINT) FROM files WHERE level = 0")
def manifest_replace(s, d):
    files = files_of(s, d).select("file", "level", "size")
    removed = files.filter("level = 0")
    added = removed.agg(F.sum("size").alias("size")).select(F.lit("merged-0").alias("file"), F.lit(1).cast("long").alias("level"), "size")
    return compact.replace(files, removed, added)


SST = "SELECT sst_id, min(key) AS min_key, max(key) AS max_key, CAST(sum(size) AS BIGINT) AS size, count(*) AS entries, max(created_at_ms) AS created_at_ms FROM sized"


@query(f"{SST} GROUP BY sst_id")
def sst_meta(s, d):
    return compact.manifest(log_of(s, d), "sst_id", F.lit(0)).withColumnRenamed("file", "sst_id").drop("level")


@query(f"{SST} WHERE sst_id = 3 GROUP BY sst_id")
def flush_sst_meta(s, d):
    return compact.manifest(log_of(s, d).filter("sst_id = 3"), "sst_id", F.lit(0)).withColumnRenamed("file", "sst_id").drop("level")


@query("SELECT level, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_files FROM files GROUP BY level")
def level_sizes(s, d):
    return files_of(s, d).groupBy("level").agg(F.sum("size").alias("size"), F.count("*").alias("n_files"))


@query("SELECT f.level, CAST(sum(f.size) AS BIGINT) AS size, CAST(16384 * pow(10, f.level) AS BIGINT) AS target, sum(f.size) > 16384 * pow(10, f.level) AS over FROM files f GROUP BY f.level")
def level_targets(s, d):
    target = F.element_at(F.array(*[F.lit(t).cast("long") for t in compact.level_targets(LEVELS)]), (F.col("level") + 1).cast("int"))
    return files_of(s, d).groupBy("level").agg(F.sum("size").alias("size")).withColumn("target", target).withColumn("over", F.col("size") > F.col("target"))


@query("SELECT a.file, a.level, b.file AS next_file FROM files a JOIN files b ON b.level = a.level + 1 AND a.max_key >= b.min_key AND a.min_key <= b.max_key")
def sst_overlap_pairs(s, d):
    return compact.overlap_pairs(files_of(s, d))


@query("SELECT file, level FROM (SELECT file, level FROM files WHERE level = 0 ORDER BY file LIMIT 20) UNION ALL SELECT b.file, b.level FROM files b WHERE b.level = 1 AND EXISTS (SELECT 1 FROM files a WHERE a.level = 0 AND a.max_key >= b.min_key AND a.min_key <= b.max_key)")
def compaction_pick_l0(s, d):
    return compact.pick_level0(files_of(s, d), 1000)


@query("""SELECT file, size, overlap, place FROM (SELECT *, sum(size) OVER () AS total, coalesce(sum(size) OVER (ORDER BY score DESC, overlap DESC, size, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY score DESC, overlap DESC, size, file) AS place
FROM (SELECT f.file, f.size, count(b.file) AS overlap, count(b.file) / greatest(1, f.size) AS score FROM files f LEFT JOIN files b ON b.level = 2 AND f.max_key >= b.min_key AND f.min_key <= b.max_key WHERE f.level = 1 GROUP BY f.file, f.size))
WHERE total > 10000 AND before < greatest(1, total - 10000) AND place <= 20""")
def compaction_pick(s, d):
    return compact.pick_by_overlap(files_of(s, d), 1, 10_000)


@query(""", o AS (SELECT *, row_number() OVER (ORDER BY min_key, file) AS pos FROM files WHERE level = 1),
w AS (SELECT a.file AS first_file, a.pos, count(*) OVER (PARTITION BY a.pos ORDER BY b.pos) AS n_files, CAST(sum(b.size) OVER (PARTITION BY a.pos ORDER BY b.pos) AS BIGINT) AS total FROM o a JOIN o b ON b.pos BETWEEN a.pos AND a.pos + 19)
SELECT first_file, n_files, total FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n_files) AS k FROM w WHERE total >= 5000) WHERE k = 1 ORDER BY total, pos LIMIT 1""")
def range_window_pick(s, d):
    return compact.pick_window(files_of(s, d), 1, 5000)


@query("SELECT a.file, a.level FROM files a WHERE a.level = 2 OR (a.level = 1 AND NOT EXISTS (SELECT 1 FROM files b WHERE b.level = 2 AND b.size > 1500 AND a.max_key >= b.min_key AND a.min_key <= b.max_key))")
def compaction_promote(s, d):
    files = files_of(s, d).filter("level < 2 or size > 1500")
    return compact.promotable(files, 1).select("file", "level").union(files_of(s, d).filter("level = 2").select("file", "level"))


@query("SELECT key, rev, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rev DESC) AS v FROM log WHERE sst_id < 2) WHERE v = 1")
def compact_level0(s, d):
    return compact.merge(log_of(s, d).filter("sst_id < 2").withColumn("created_at_src", F.col("created_at_ms")))


@query("SELECT key, rev, value FROM newest")
def compact_latest(s, d):
    return compact.merge(log_of(s, d).withColumn("created_at_src", F.col("created_at_ms")))


CREATED = "(SELECT sst_id, max(created_at_ms) AS created_at_src FROM log GROUP BY sst_id)"


def with_source_time(log: DataFrame) -> DataFrame:
    return log.join(log.groupBy("sst_id").agg(F.max("created_at_ms").alias("created_at_src")), "sst_id")


@query(f"SELECT n.key, n.rev, n.value FROM newest n JOIN {CREATED} c ON n.sst_id = c.sst_id WHERE NOT (n.value IS NULL AND n.rev > 300 AND {NOW} - c.created_at_src > 86400000)")
def compact_tombstone_gc(s, d):
    return compact.merge(with_source_time(log_of(s, d)), NOW, active_rev=300)


@query(f"SELECT key, rev, value FROM (SELECT r.key, r.rev, r.value, row_number() OVER (PARTITION BY r.key ORDER BY r.rev DESC) AS v FROM ranked r JOIN (SELECT n.key, n.value IS NULL AND {NOW} - c.created_at_src > 86400000 AS dead FROM newest n JOIN {CREATED} c ON n.sst_id = c.sst_id) x ON r.key = x.key WHERE NOT (x.dead AND r.value IS NULL)) WHERE v = 1")
def compact_promotion(s, d):
    return compact.merge(with_source_time(log_of(s, d)), NOW, promote=True)


@query("SELECT l.key, l.rev, l.value FROM log l WHERE l.rev >= coalesce((SELECT max(m.rev) FROM log m WHERE m.key = l.key AND m.rev <= 500), 0)")
def compact_keep_history(s, d):
    return key_rev_value(compact.merge_history(log_of(s, d), REV))


@query(""", e AS (SELECT sst_id, key, rev, size, row_number() OVER (PARTITION BY sst_id ORDER BY key, rev) AS i FROM sized),
g AS (SELECT sst_id, key, size, i, CAST(0 AS BIGINT) AS part, CAST(size AS BIGINT) AS used FROM e WHERE i = 1
  UNION ALL SELECT e.sst_id, e.key, e.size, e.i, CASE WHEN g.used + e.size <= 1024 THEN g.part ELSE g.part + 1 END, CAST(CASE WHEN g.used + e.size <= 1024 THEN g.used + e.size ELSE e.size END AS BIGINT) FROM g JOIN e ON e.sst_id = g.sst_id AND e.i = g.i + 1)
SELECT sst_id, part, min(key) AS min_key, max(key) AS max_key, CAST(sum(size) AS BIGINT) AS size, count(*) AS entries FROM g GROUP BY sst_id, part""")
def split_by_size(s, d):
    return compact.split_by_size(log_of(s, d), "sst_id", 1024)


@query("SELECT key, rev, CAST(size AS BIGINT) AS size FROM sized")
def entry_sizes(s, d):
    return log_of(s, d).select("key", "rev", compact.entry_bytes().alias("size"))


@query("SELECT sst_id, CAST(greatest(6, least(18, round(avg(strlen(key)) / 8) + 6)) AS BIGINT) AS bits FROM log GROUP BY sst_id")
def bloom_bits(s, d):
    return log_of(s, d).groupBy("sst_id").agg(F.avg(F.octet_length("key")).alias("a")).select("sst_id", compact.bloom_bits(F.col("a")).alias("bits"))


@query(f"SELECT DISTINCT p.key, l.sst_id FROM {PROBES} p JOIN log l ON p.key = l.key")
def bloom_membership(s, d):
    """Runs that hold each key: filters are built for all runs, probed with every key and run
    whose range allows it, and what passes is confirmed. A false negative would lose a row."""
    entries = log_of(s, d).select(F.col("sst_id").alias("run"), "key").distinct()
    ranges = entries.groupBy("run").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    asked = probe_keys(s, d).join(F.broadcast(ranges), F.col("key").between(F.col("lo"), F.col("hi"))).select("run", "key")
    maybe = bloom.probe(bloom.build(entries), asked)
    return maybe.join(entries, ["run", "key"], "left_semi").select("key", F.col("run").alias("sst_id"))


@query("SELECT CAST(5000 AS BIGINT) AS probes, true AS below_six_percent")
def bloom_false_positive_rate(s, d):
    """Keys that no run holds, against the filter of all keys."""
    filters = bloom.build(keys_of(s, d).select(F.lit(0).alias("run"), "key"))
    absent = s.range(5000).select(F.lit(0).alias("run"), F.concat(F.lit("absent:"), F.col("id").cast("string")).alias("key"))
    hits = bloom.probe(filters, absent).agg(F.count("*").alias("hits"))
    return hits.select(F.lit(5000).cast("long").alias("probes"), (F.col("hits") < 300).alias("below_six_percent"))


@query("SELECT sst_id, CAST(5 + sum(size) + sum(strlen(key)) + 12 * count(*) + ceil(count(*) * 10 / 8) + 28 AS BIGINT) AS file_bytes FROM sized GROUP BY sst_id")
def file_sizes(s, d):
    per = log_of(s, d).groupBy("sst_id").agg(F.sum(compact.entry_bytes()).alias("b"), F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("k"))
    return per.select("sst_id", compact.file_bytes(F.col("b"), F.col("n"), F.col("k")).alias("file_bytes"))


@query()
def compress_decision(s, d):
    return cl.table(s, d, "documents").select("doc_id", fn.worth_compressing("text").alias("compress"))


# Figures ------------------------------------------------------------------------------------

@query("SELECT max(rev) AS max_rev FROM log")
def max_rev(s, d):
    return log_of(s, d).agg(F.max("rev").alias("max_rev"))


@query("SELECT min(rev) AS min_rev, max(rev) AS max_rev FROM log WHERE rev % 97 = 0")
def active_rev_bounds(s, d):
    return log_of(s, d).filter("rev % 97 = 0").agg(F.min("rev").alias("min_rev"), F.max("rev").alias("max_rev"))


@query("SELECT min(e) AS min_wal_offset FROM (SELECT sst_id, max(wal_end) AS e FROM wal GROUP BY sst_id)")
def min_wal_offset(s, d):
    return cl.with_offsets(log_of(s, d)).groupBy("sst_id").agg(F.max("wal_end").alias("e")).agg(F.min("e").alias("min_wal_offset"))


@query("SELECT count(*) AS entries, CAST(count(*) - count(value) AS BIGINT) AS tombstones, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT key) AS n_keys, count(DISTINCT tx_id) AS txs, count(lease_id) AS leased FROM wal")
def log_metrics(s, d):
    return log_of(s, d).agg(F.count("*").alias("entries"), (F.count("*") - F.count("value")).alias("tombstones"), F.sum(cl.record_bytes()).alias("bytes"), F.countDistinct("key").alias("n_keys"), F.countDistinct("tx_id").alias("txs"), F.count("lease_id").alias("leased"))


# Watch ------------------------------------------------------------------------------------------

MATCH = "(s.type = 'all' OR (s.type = 'exact' AND l.key = s.pattern) OR (s.type = 'prefix' AND starts_with(l.key, s.pattern)) OR (s.type = 'suffix' AND ends_with(l.key, s.pattern)) OR (s.type = 'contains' AND contains(l.key, s.pattern)))"
DELIVERED = f"(SELECT * FROM (SELECT CAST(s.id AS BIGINT) AS id, s.once, s.last_seen_rev, l.key, l.rev, l.value, row_number() OVER (PARTITION BY s.id ORDER BY l.rev) AS k FROM log l JOIN subs s ON {MATCH}) WHERE k = 1 OR NOT once)"
RESUMED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rev) AS j FROM (SELECT CAST(s.id AS BIGINT) AS id, s.once, s.last_seen_rev, l.key, l.rev, l.value FROM log l JOIN subs s ON {MATCH} WHERE l.rev > (SELECT min(coalesce(last_seen_rev, 0)) FROM subs))) WHERE (j = 1 OR NOT once) AND rev > coalesce(last_seen_rev, 0))"


@query(f"SELECT id, key, rev FROM {DELIVERED} WHERE once")
def watch_once(s, d):
    return watch.deliveries(log_of(s, d), subs_of(s)).filter("once").select("id", "key", "rev")


@query(f"SELECT id, count(*) AS n, min(rev) AS first_rev, max(rev) AS last_rev FROM {DELIVERED} GROUP BY id")
def watch_match_matrix(s, d):
    return watch.deliveries(log_of(s, d), subs_of(s)).groupBy("id").agg(F.count("*").alias("n"), F.min("rev").alias("first_rev"), F.max("rev").alias("last_rev"))


@query("SELECT rev, key, value FROM log WHERE rev > 400 AND key LIKE 'view:%'")
def watch_replay_min_rev(s, d):
    return watch.replay(log_of(s, d).filter(scan.matches("prefix", "view:")), 400).select("rev", "key", "value")


@query("SELECT rev, key, wal_end FROM wal WHERE wal_end > 30000 AND key LIKE 'view:%'")
def watch_replay_offset(s, d):
    return watch.replay(cl.with_offsets(log_of(s, d)), min_offset=30_000).filter(scan.matches("prefix", "view:")).select("rev", "key", "wal_end")


@query(f"SELECT id, key, rev FROM {RESUMED}")
def watch_resume(s, d):
    return watch.resume(log_of(s, d), subs_of(s)).select("id", "key", "rev")


@query(f"SELECT CAST(s.id AS BIGINT) AS id, CAST(greatest(s.last_seen_rev, r.rev) AS BIGINT) AS last_seen_rev FROM subs s LEFT JOIN (SELECT id, max(rev) AS rev FROM {RESUMED} GROUP BY id) r ON r.id = s.id")
def watch_last_seen(s, d):
    return watch.last_seen(log_of(s, d), subs_of(s))


@query("SELECT rev, key FROM log WHERE rev > (SELECT max(rev) - 50 FROM log) - 100")
def watch_monitor(s, d):
    log = log_of(s, d)
    since = (log.agg(F.max("rev")).head()[0] or 0) - 50
    return watch.monitor(log, 100, since).select("rev", "key")


@query("SELECT CAST(id AS BIGINT) AS id, type, pattern, once, CAST(last_seen_rev AS BIGINT) AS last_seen_rev FROM subs")
def subs_restore(s, d):
    """Subscriptions kept as files and attached again."""
    from revlake.streaming import sinks

    path = folder(s)
    sinks.save(subs_of(s), path)
    return sinks.load(s, path)


@query(f"SELECT CAST(s.id AS BIGINT) AS id, s.type, s.pattern, s.once, CAST(greatest(s.last_seen_rev, r.rev) AS BIGINT) AS last_seen_rev FROM subs s LEFT JOIN (SELECT id, max(rev) AS rev FROM {RESUMED} GROUP BY id) r ON r.id = s.id WHERE NOT (s.once AND s.id IN (SELECT id FROM {DELIVERED}))")
def subs_export(s, d):
    return watch.export(log_of(s, d), subs_of(s))


# Scalar functions ------------------------------------------------------------------------------------

@query("SELECT key, lower(hex(encode(key))) AS h, decode(unhex(hex(encode(key)))) AS back FROM (SELECT DISTINCT key FROM log)")
def fn_hex_key(s, d):
    return keys_of(s, d).select("key", F.lower(F.hex("key")).alias("h"), F.decode(F.unhex(F.hex("key")), "UTF-8").alias("back"))


@query("SELECT key, to_base64(encode(key)) AS b, decode(from_base64(to_base64(encode(key)))) AS back FROM (SELECT DISTINCT key FROM log)")
def fn_base64(s, d):
    return keys_of(s, d).select("key", F.base64(F.col("key").cast("binary")).alias("b"), F.decode(F.unbase64(F.base64(F.col("key").cast("binary"))), "UTF-8").alias("back"))


@query("SELECT key, CAST(CASE WHEN encode(key) < encode('click:0010') THEN -1 WHEN encode(key) > encode('click:0010') THEN 1 ELSE 0 END AS BIGINT) AS cmp, reverse(key) AS rev_key, starts_with(key, 'cl') AS sw, ends_with(key, '7') AS ew FROM (SELECT DISTINCT key FROM log)")
def fn_bytes_cmp(s, d):
    b, x = F.col("key").cast("binary"), F.lit("click:0010").cast("binary")
    return keys_of(s, d).select("key", F.when(b < x, -1).when(b > x, 1).otherwise(0).cast("long").alias("cmp"), F.reverse("key").alias("rev_key"), F.startswith(b, F.lit("cl").cast("binary")).alias("sw"), F.endswith(b, F.lit("7").cast("binary")).alias("ew"))


@query("SELECT l.key, CAST((l.key >= 'click:0010')::INT + (l.key >= 'purchase:0000')::INT + (l.key >= 'view:0005')::INT AS BIGINT) AS pos FROM (SELECT DISTINCT key FROM log) l")
def fn_upper_bound(s, d):
    bounds = F.array(*[F.lit(x) for x in ("click:0010", "purchase:0000", "view:0005")])
    return keys_of(s, d).select("key", fn.upper_bound(bounds, F.col("key")).alias("pos"))


BYTES = "list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substring(key, i, 1)) AS BIGINT))"


@query(f"SELECT key, CAST(((len(b) + list_sum(list_transform(range(1, len(b) + 1), lambda i: (len(b) - i + 1) * b[i]))) % 65521) * 65536 + (1 + list_sum(b)) % 65521 AS BIGINT) AS h FROM (SELECT key, {BYTES} AS b FROM (SELECT DISTINCT key FROM log))")
def fn_adler32(s, d):
    return keys_of(s, d).select("key", fn.adler32(F.col("key")).alias("h"))


@query(", f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(2166136261 AS BIGINT) AS h FROM log UNION ALL SELECT key, i + 1, (xor(h, CAST(ascii(substring(key, i + 1, 1)) AS BIGINT)) * 16777619) & 4294967295 FROM f WHERE i < length(key)) SELECT key, h FROM f WHERE i = length(key)")
def fn_fnv1a(s, d):
    return keys_of(s, d).select("key", fn.fnv1a(F.col("key")).alias("h"))


@query("SELECT rev, CAST(CASE WHEN rev * rev < 128 THEN 1 WHEN rev * rev < 16384 THEN 2 WHEN rev * rev < 2097152 THEN 3 WHEN rev * rev < 268435456 THEN 4 WHEN rev * rev < 34359738368 THEN 5 ELSE 6 END AS BIGINT) AS n FROM log")
def fn_varint_len(s, d):
    return log_of(s, d).select("rev", compact.varint_length(F.col("rev") * F.col("rev")).alias("n"))


_TABLE = ", ".join(map(str, fn._CRC))


@query(f", f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS h FROM log UNION ALL SELECT key, i + 1, xor(([{_TABLE}])[(xor(h, CAST(ascii(substring(key, i + 1, 1)) AS BIGINT)) & 255) + 1]::BIGINT, h >> 8) FROM f WHERE i < length(key)) SELECT key, xor(h, 4294967295) AS h FROM f WHERE i = length(key)")
def fn_checksum(s, d):
    return keys_of(s, d).select("key", fn.checksum_column(F.col("key")).alias("h"))


_DIGIT = "lower(lpad(hex((x // (128 ** k)::BIGINT) % 128 + CASE WHEN k < n - 1 THEN 128 ELSE 0 END), 2, '0'))"


@query(f"SELECT rev, string_agg({_DIGIT}, '' ORDER BY k) AS h, any_value(x) AS back FROM (SELECT rev, x, n, unnest(range(0, n)) AS k FROM (SELECT rev, rev * rev AS x, CASE WHEN rev * rev < 128 THEN 1 WHEN rev * rev < 16384 THEN 2 WHEN rev * rev < 2097152 THEN 3 WHEN rev * rev < 268435456 THEN 4 WHEN rev * rev < 34359738368 THEN 5 ELSE 6 END AS n FROM log)) GROUP BY rev")
def fn_varint(s, d):
    h = fn.varint_hex(F.col("rev") * F.col("rev"))
    return log_of(s, d).select("rev", h.alias("h"), fn.unvarint_hex(h).alias("back"))


@query("SELECT rev, lower(string_agg(lpad(hex((rev // (256 ** k)::BIGINT) % 256), 2, '0'), '' ORDER BY k)) AS h FROM (SELECT rev, unnest(range(0, 8)) AS k FROM log) GROUP BY rev")
def fn_u64(s, d):
    return log_of(s, d).select("rev", fn.u64_little_endian_hex(F.col("rev")).alias("h"))


_TEXT = "CASE WHEN {0} IS NULL THEN 'c0' WHEN strlen({0}) < 32 THEN lower(hex(strlen({0}) + 160)) || lower(hex(encode({0}))) ELSE 'd9' || lower(lpad(hex(strlen({0})), 2, '0')) || lower(hex(encode({0}))) END"


@query(f"SELECT rev, '83a36b6579' || {_TEXT.format('key')} || 'a5' || '76616c7565' || {_TEXT.format('value')} || 'a3726576' || CASE WHEN rev < 128 THEN lower(lpad(hex(rev), 2, '0')) WHEN rev < 256 THEN 'cc' || lower(lpad(hex(rev), 2, '0')) WHEN rev < 65536 THEN 'cd' || lower(lpad(hex(rev), 4, '0')) ELSE 'ce' || lower(lpad(hex(rev), 8, '0')) END AS record FROM log")
def fn_msgpack(s, d):
    record = fn.msgpack_map_hex(key=fn.msgpack_text_hex(F.col("key")), value=fn.msgpack_text_hex(F.col("value")), rev=fn.msgpack_long_hex(F.col("rev")))
    return log_of(s, d).select("rev", record.alias("record"))
