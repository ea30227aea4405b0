"""Subscriptions over a log in batch form: matching, once, replay and resume.

``subs`` has id, type, pattern, once, last_seen_rev. Matching is one hash join whatever
the number of subscriptions: each has a token, an event has the tokens of the kinds and
lengths that occur, and substrings found by a gram are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def matches() -> Column:
    key, pattern = F.col("key"), F.col("pattern")
    return (
        F.when(F.col("type") == "all", True)
        .when(F.col("type") == "exact", key == pattern)
        .when(F.col("type") == "prefix", key.startswith(pattern))
        .when(F.col("type") == "suffix", key.endswith(pattern))
        .when(F.col("type") == "contains", key.contains(pattern))
        .otherwise(False)
    )


#: Parts that subscriptions to everything are dealt to, and characters of a gram.
SALTS, GRAM = 16, 3
#: Bytes of tokens that may be broadcast; more are shuffled. Events, many tokens each, never are broadcast.
BROADCAST_BYTES = 8 << 20


def _tokens(subs: DataFrame) -> DataFrame:
    """``subs`` with the kind and the token by which events find them."""
    size, everything = F.length("pattern"), (F.col("type") == "all") | (F.col("type").isin("prefix", "suffix", "contains") & (F.col("pattern") == ""))
    kind = F.when(everything, F.lit("all")).otherwise(F.col("type"))
    size = F.when(kind.isin("all", "exact"), 0).when(kind == "contains", F.least(size, F.lit(GRAM))).otherwise(size)
    usable = subs.withColumns({"kind": kind, "size": size}).filter(everything | (F.col("type").isin("exact", "prefix", "suffix", "contains") & F.col("pattern").isNotNull()))
    own = F.array(F.when(F.col("kind") == "contains", F.expr("left(pattern, size)")).otherwise(F.col("pattern")))
    salts = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: i.cast("string"))
    return usable.withColumn("token", F.explode(F.when(F.col("kind") == "all", salts).otherwise(own)))


def matched(log: DataFrame, subs: DataFrame) -> DataFrame:
    """id, once, last_seen_rev, key, rev, value of every event and subscription that match."""
    tokens = _tokens(subs.select("id", "type", "pattern", "once", "last_seen_rev"))
    # At most a row for each kind and length of a pattern.
    held = F.lit(64) + F.octet_length("token") + F.coalesce(F.octet_length("pattern"), F.lit(0))
    counts = tokens.groupBy("kind", "size").agg(F.sum(held).alias("bytes")).collect()
    shapes = sorted((r["kind"], r["size"]) for r in counts)
    key, found = F.col("key"), []
    for kind, size in shapes:
        if kind == "contains":
            grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key) - (size - 1))), lambda i: F.substring(key, i, F.lit(size)))  # noqa: B023
            found.append(F.transform(F.array_distinct(grams), lambda g: F.struct(F.lit("contains").alias("kind"), g.alias("token"))))
        else:
            token = {"all": F.pmod(F.xxhash64("key", "rev"), F.lit(SALTS)).cast("string"), "exact": key, "prefix": F.left(key, F.lit(size)), "suffix": F.right(key, F.lit(size))}[kind]
            found.append(F.array(F.struct(F.lit(kind).alias("kind"), token.alias("token"))))
    if not found:
        return log.limit(0).join(subs.limit(0).select("id", "once", "last_seen_rev").withColumn("key", F.lit(None).cast("string")), "key").select("id", "once", "last_seen_rev", "key", "rev", "value")
    events = log.select("key", "rev", "value", F.explode(F.array_distinct(F.concat(*found))).alias("t")).select("key", "rev", "value", "t.*")
    # By its size before the explode Spark takes a small log for the side to broadcast, so the sides are named here.
    both = events.join(F.broadcast(tokens) if sum(r["bytes"] for r in counts) <= BROADCAST_BYTES else tokens.hint("merge"), ["kind", "token"])
    sure = (F.col("kind") != "contains") | F.contains("key", "pattern")
    return both.filter(sure & ((F.col("kind") == "all") | matches())).select("id", "once", "last_seen_rev", "key", "rev", "value")


def deliveries(log: DataFrame, subs: DataFrame) -> DataFrame:
    """Every event with every subscription it matches; once-subscriptions take their first."""
    first = matched(log, subs.filter("once")).groupBy("id").agg(F.min_by(F.struct("once", "last_seen_rev", "key", "rev", "value"), "rev").alias("f")).select("id", "f.*")
    return matched(log, subs.filter("not once")).union(first)


def replay(log: DataFrame, min_rev: int | None = None, min_offset: int | None = None) -> DataFrame:
    """Events above a revision and whose record ends after an offset."""
    if min_rev is not None:
        log = log.filter(F.col("rev") > min_rev)
    return log if min_offset is None else log.filter(F.col("wal_end") > min_offset)


def resume(log: DataFrame, subs: DataFrame) -> DataFrame:
    """Deliveries that each subscription has not seen. The least revision seen by all
    cuts the log before the join."""
    least = subs.agg(F.min(F.coalesce("last_seen_rev", F.lit(0))).alias("r")).head()
    return deliveries(replay(log, least["r"] if least else None), subs).filter(F.col("rev") > F.coalesce("last_seen_rev", F.lit(0)))


def last_seen(log: DataFrame, subs: DataFrame) -> DataFrame:
    """id and the greatest revision delivered or seen before."""
    new = resume(log, subs).groupBy("id").agg(F.max("rev").alias("rev"))
    return subs.join(new, "id", "left").select("id", F.greatest("last_seen_rev", "rev").alias("last_seen_rev"))


def export(log: DataFrame, subs: DataFrame) -> DataFrame:
    """Subscriptions to keep after the log: once-subscriptions that fired are gone."""
    seen = last_seen(log, subs).withColumnRenamed("last_seen_rev", "now")
    fired = deliveries(log, subs.filter("once")).select("id").distinct()
    return subs.join(fired, "id", "left_anti").join(seen, "id").select("id", "type", "pattern", "once", F.col("now").alias("last_seen_rev"))


def restore(spark, rows: DataFrame) -> DataFrame:
    """The subscriptions that ``export`` gave, as they came back from storage; a row without id or type is left out."""
    return rows.filter("id is not null and type is not null").select(F.col("id").cast("long").alias("id"), "type", "pattern", F.coalesce(F.col("once").cast("boolean"), F.lit(False)).alias("once"), F.col("last_seen_rev").cast("long").alias("last_seen_rev"))


def monitor(log: DataFrame, last: int, since: int) -> DataFrame:
    """The tail of a log and all that came after revision ``since``, each event once."""
    tail = log.filter(F.col("rev") <= since).orderBy(F.desc("rev")).limit(last)
    return tail.unionByName(log.filter(F.col("rev") > since))
