"""Leases: keys that live until a moment. Every operator takes ``now`` in milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.operators.views import newest

DEFAULT_TTL_MS = 60_000


def grants(log: DataFrame) -> DataFrame:
    """lease_id and its last known expiry."""
    return log.filter(F.col("lease_id").isNotNull()).groupBy("lease_id").agg(F.max("lease_expires_at_ms").alias("expires_at_ms"))


def info(log: DataFrame) -> DataFrame:
    """Every lease with its expiry and how many keys it holds, a row for each key; a lease without keys has one row."""
    held = effective(log).select("lease_id", "key")
    counts = held.groupBy("lease_id").agg(F.count("*").alias("n_keys"))
    known = grants(log).join(counts, "lease_id", "left").join(held, "lease_id", "left")
    return known.select("lease_id", "expires_at_ms", F.coalesce("n_keys", F.lit(0)).cast("long").alias("n_keys"), "key")


def effective(log: DataFrame) -> DataFrame:
    """The lease each live key is under: that of its last put with one since the last
    delete; a put without a lease keeps it, a delete ends it."""
    gone = log.filter(F.col("value").isNull()).groupBy("key").agg(F.max("rev").alias("gone"))
    put = log.filter(F.col("value").isNotNull() & F.col("lease_id").isNotNull())
    last = put.groupBy("key").agg(F.max_by(F.struct("lease_id", "lease_expires_at_ms", "rev"), "rev").alias("l"))
    return last.join(gone, "key", "left").filter(F.col("gone").isNull() | (F.col("l.rev") > F.col("gone"))).select("key", "l.lease_id", "l.lease_expires_at_ms")


def renew(granted: DataFrame, renewals: DataFrame) -> DataFrame:
    """``granted`` with the last renewal of each lease; unknown leases are ignored."""
    last = renewals.groupBy("lease_id").agg(F.max_by(F.col("at_ms") + F.greatest(F.lit(1), "ttl_ms"), "at_ms").alias("renewed"))
    return granted.join(last, "lease_id", "left").select("lease_id", F.coalesce("renewed", "expires_at_ms").alias("expires_at_ms"))


def expired(granted: DataFrame, now: int) -> DataFrame:
    """Expiry is inclusive."""
    return granted.filter(F.col("expires_at_ms") <= now)


def expired_keys(log: DataFrame, now: int) -> DataFrame:
    return effective(log).join(expired(grants(log), now).select("lease_id"), "lease_id", "left_semi").select("key", "lease_id")


def evict(log: DataFrame, now: int) -> DataFrame:
    """The live view without keys of expired leases."""
    return newest(log).filter(F.col("value").isNotNull()).join(expired_keys(log, now), "key", "left_anti")


def eviction_ops(log: DataFrame, now: int, base_rev: int) -> DataFrame:
    """Tombstones of one transaction a lease, in order of lease and key, with the lease's data."""
    dead = ranked(expired_keys(log, now).join(grants(log), "lease_id"), "lease_id", then=("key",))
    return dead.select("key", (F.lit(base_rev) + F.col("rank")).cast("long").alias("rev"), F.lit(None).cast("string").alias("value"), "lease_id", F.col("expires_at_ms").alias("lease_expires_at_ms"))


def revoke(log: DataFrame, lease_id: int, delete_keys: bool = False) -> DataFrame:
    """The live view after a lease is revoked: its keys stay or go."""
    view = newest(log).filter(F.col("value").isNotNull())
    if not delete_keys:
        return view
    return view.join(effective(log).filter(F.col("lease_id") == lease_id).select("key"), "key", "left_anti")


def events(log: DataFrame, now: int) -> DataFrame:
    """A grant for every lease, and for expired ones: evict with keys, expire without."""
    held = effective(log).groupBy("lease_id").agg(F.count("*").alias("n_keys"))
    over = expired(grants(log), now).join(held, "lease_id", "left").select("lease_id", F.when(F.col("n_keys") > 0, "evict").otherwise("expire").alias("event"), F.coalesce("n_keys", F.lit(0)).alias("n_keys"))
    return grants(log).select("lease_id", F.lit("grant").alias("event"), F.lit(0).cast("long").alias("n_keys")).union(over)


def ranked(rows: DataFrame, order: str, segment: int = 10_000, fan: int = 1000, then: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``rank``, from 1 in the order of the whole number ``order`` and of ``then``. As with
    offsets, counts go within segments, groups of ``fan`` segments, and over the groups."""
    rows = rows.withColumn("segment", F.coalesce(F.expr(f"`{order}` div {segment}"), F.lit(-(2**63))))
    segments = rows.groupBy("segment").agg(F.count("*").alias("n")).withColumn("g", F.expr(f"segment div {fan}"))
    groups = segments.groupBy("g").agg(F.sum("n").alias("n"))
    before = lambda by, column: F.coalesce(F.sum("n").over(by.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("g", before(Window.partitionBy(), "g").alias("g0"))
    starts = segments.join(groups, "g").select("segment", (F.col("g0") + before(Window.partitionBy("g"), "segment")).alias("s0"))
    own = F.row_number().over(Window.partitionBy("segment").orderBy(order, *then))
    return rows.withColumn("own", own).join(starts, "segment").withColumn("rank", F.col("s0") + F.col("own")).drop("segment", "own", "s0")


def resolve(puts: DataFrame, known: DataFrame, policy: str, base_id: int, now: int, ttl_ms: int = DEFAULT_TTL_MS) -> DataFrame:
    """Puts (seq, key, lease_id) against known leases under an unknown-lease policy:
    *create* makes a new lease a put, *ignore* drops the lease, *throw* marks an error."""
    marked = puts.join(known.select("lease_id", F.lit(True).alias("known")), "lease_id", "left").withColumn("unknown", F.col("lease_id").isNotNull() & F.col("known").isNull())
    if policy == "throw":
        return marked.select("seq", "key", F.when(~F.col("unknown"), F.col("lease_id")).alias("lease_id"), F.col("unknown").alias("error"))
    if policy == "ignore":
        return marked.select("seq", "key", F.when(~F.col("unknown"), F.col("lease_id")).alias("lease_id"), F.lit(False).alias("error"))
    fresh = ranked(marked.filter("unknown"), "seq")
    made = fresh.select("seq", "key", (F.lit(base_id) + F.col("rank")).cast("long").alias("lease_id"), F.lit(False).alias("error"))
    return marked.filter(~F.col("unknown")).select("seq", "key", "lease_id", F.lit(False).alias("error")).union(made)


def after(ops: DataFrame) -> DataFrame:
    """Leases after operations (seq, op, lease_id, key, ttl_ms, at_ms) on an empty table.

    *grant* makes a lease that ends ttl (1 ms at least) after its moment, *renew* moves the
    end of a known one, *attach* puts a key under one that is granted before and not revoked,
    *revoke* ends it. A lease without keys exists like any other. lease_id, expires_at_ms,
    revoked and n_keys."""
    until = F.col("at_ms") + F.greatest(F.lit(1).cast("long"), "ttl_ms")
    timed = ops.withColumn("until", F.when(F.col("op").isin("grant", "renew"), until))
    leases = timed.groupBy("lease_id").agg(
        F.min(F.when(F.col("op") == "grant", F.col("seq"))).alias("granted"),
        F.min(F.when(F.col("op") == "revoke", F.col("seq"))).alias("revoked_at"),
    ).filter("granted is not null")
    kept = timed.join(leases, "lease_id").filter((F.col("seq") >= F.col("granted")) & (F.col("revoked_at").isNull() | (F.col("seq") <= F.col("revoked_at"))))
    ends = kept.groupBy("lease_id", "revoked_at").agg(F.max_by("until", F.when(F.col("until").isNotNull(), F.col("seq"))).alias("expires_at_ms"), F.countDistinct(F.when(F.col("op") == "attach", F.col("key"))).alias("n_keys"))
    return ends.select("lease_id", "expires_at_ms", F.col("revoked_at").isNotNull().alias("revoked"), "n_keys")


def operation_events(ops: DataFrame, now: int) -> DataFrame:
    """lease_id, event and n_keys: a grant for each lease; revoke for a revoked one; for others
    that are over by ``now``, evict with keys and expire without."""
    known = after(ops)
    over = F.when(F.col("revoked"), "revoke").when((F.col("expires_at_ms") <= now) & (F.col("n_keys") > 0), "evict").when(F.col("expires_at_ms") <= now, "expire")
    ended = known.withColumn("event", over).filter("event is not null").select("lease_id", "event", "n_keys")
    return known.select("lease_id", F.lit("grant").alias("event"), F.lit(0).cast("long").alias("n_keys")).union(ended)
