"""Changelogs: revisioned puts and deletes as a DataFrame.

Columns of a log: key, rev (unique, the total order), value (null: deleted),
created_at_ms, lease_id, lease_expires_at_ms, tx_id, sst_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEASE_MS = 21_600_000
LOG_COLUMNS = ("key", "rev", "value", "created_at_ms", "lease_id", "lease_expires_at_ms", "tx_id", "sst_id")

OP = T.StructType([T.StructField(n, t) for n, t in (("key", T.StringType()), ("value", T.StringType()), ("rev", T.LongType()), ("createdAt", T.LongType()), ("leaseId", T.LongType()), ("leaseExpiresAt", T.LongType()))])
#: A write-ahead record: a single operation, or a transaction that holds several.
WAL = T.StructType([T.StructField("tx", T.BooleanType()), *OP.fields, T.StructField("ops", T.ArrayType(OP))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts):
    """Milliseconds of a timestamp without time zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400_000 + seconds.cast("long") * 1000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def from_events(events: DataFrame) -> DataFrame:
    """The canonical changelog of an ``events`` table."""
    leased = F.col("event_id") % 5 == 0
    created = epoch_ms("ts")
    return events.select(
        F.concat("event_type", F.lit(":"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("key"),
        (F.col("event_id") + 1).alias("rev"),
        F.when(F.col("event_id") % 7 != 3, F.col("props")).alias("value"),
        created.alias("created_at_ms"),
        F.when(leased, F.col("user_id") % 16 + 1).alias("lease_id"),
        F.when(leased, created + LEASE_MS).alias("lease_expires_at_ms"),
        F.expr("event_id div 4").alias("tx_id"),
        F.expr("event_id div 250").alias("sst_id"),
    )


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def to_wal(log: DataFrame) -> DataFrame:
    """A log's transactions as nested records; a transaction of one is a single operation."""
    op = F.struct("key", "value", "rev", F.lit(None).cast("long").alias("createdAt"), "lease_id", "lease_expires_at_ms")
    txs = log.groupBy("tx_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rev").alias("o"), op.alias("op")))).alias("ops"), F.max("created_at_ms").alias("createdAt"))
    return txs.select(F.lit(True).alias("tx"), F.transform("ops", lambda x: x["op"]).alias("ops"), "createdAt")


def flatten_wal(records: DataFrame) -> DataFrame:
    """Operations of nested records; what an operation lacks it takes from its transaction."""
    own = F.struct(*[F.col(n).alias(n) for n in OP.names])
    ops = F.when(F.coalesce("tx", F.lit(False)), F.col("ops")).otherwise(F.array(own))
    rows = records.select("createdAt", "leaseId", "leaseExpiresAt", F.explode(ops).alias("op"))
    return rows.select(
        F.col("op.key").alias("key"),
        F.col("op.rev").alias("rev"),
        F.col("op.value").alias("value"),
        F.coalesce("op.createdAt", "createdAt").alias("created_at_ms"),
        F.coalesce("op.leaseId", "leaseId").alias("lease_id"),
        F.coalesce("op.leaseExpiresAt", "leaseExpiresAt").alias("lease_expires_at_ms"),
    )


def record_bytes():
    """Bytes of one log record: header and trailer, key and value."""
    return (F.lit(24) + F.length("key") + F.coalesce(F.length("value"), F.lit(0))).cast("long")


def with_offsets(log: DataFrame, fan: int = 1000) -> DataFrame:
    """Byte span of every record. Running sums go within segments, within groups of
    ``fan`` segments, and over the groups, so no task sees the whole log."""
    rows = log.withColumn("bytes", record_bytes())
    segments = rows.groupBy("sst_id").agg(F.sum("bytes").alias("n")).withColumn("g", F.expr(f"sst_id div {fan}"))
    groups = segments.groupBy("g").agg(F.sum("n").alias("n"))
    before = lambda by, order: F.coalesce(F.sum("n").over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("g", before(Window.partitionBy(), "g").alias("g0"))
    starts = segments.join(groups, "g").select("sst_id", (F.col("g0") + before(Window.partitionBy("g"), "sst_id")).alias("s0"))
    own = F.sum("bytes").over(Window.partitionBy("sst_id").orderBy("rev").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("own", own).join(starts, "sst_id")
    return out.withColumn("wal_end", (F.col("s0") + F.col("own")).cast("long")).withColumn("wal_start", F.col("wal_end") - F.col("bytes")).drop("own", "s0", "bytes")
