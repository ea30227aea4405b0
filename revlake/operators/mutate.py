"""Mutations as functions from logs to logs: puts, deletes, transactions, compare-and-swap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.operators.views import newest


def numbered(ops: DataFrame, base_rev: int, order: str) -> DataFrame:
    """Consecutive revisions above ``base_rev`` in ``order``: counts per range of order
    give each range its start, so that only ranges are summed in one task."""
    spans = ops.withColumn("_b", F.expr(f"{order} div 100000"))
    counts = spans.groupBy("_b").agg(F.count("*").alias("n"))
    starts = counts.select("_b", F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return spans.withColumn("_r", rank).join(starts, "_b").withColumn("rev", (F.lit(base_rev) + F.col("s") + F.col("_r")).cast("long")).drop("_b", "_r", "s")


def append(log: DataFrame, ops: DataFrame) -> DataFrame:
    """``log`` with ``ops``; columns that the operations lack are null."""
    return log.unionByName(ops, allowMissingColumns=True)


def puts(log: DataFrame, ops: DataFrame, base_rev: int, order: str) -> DataFrame:
    return append(log, numbered(ops, base_rev, order).select("key", "rev", "value"))


def bulk(log: DataFrame, key_values: DataFrame, base_rev: int, tx_id: int) -> DataFrame:
    """One transaction from a row with an array ``entries`` of (key, value): the
    position in it decides, the last of equal keys wins."""
    rows = key_values.select(F.posexplode("entries").alias("i", "e"))
    return append(log, rows.select(F.col("e.key").alias("key"), (F.lit(base_rev) + 1 + F.col("i")).cast("long").alias("rev"), F.col("e.value").alias("value"), F.lit(tx_id).cast("long").alias("tx_id")))


def deletes(log: DataFrame, keys: DataFrame, base_rev: int, order: str) -> DataFrame:
    return append(log, numbered(keys, base_rev, order).select("key", "rev", F.lit(None).cast("string").alias("value")))


def commit(log: DataFrame, ops: DataFrame, committed: DataFrame) -> DataFrame:
    """``log`` with the operations of committed transactions; others leave no trace."""
    return append(log, ops.join(committed.select("tx_id"), "tx_id", "left_semi"))


def cas_check(log: DataFrame, attempts: DataFrame) -> DataFrame:
    """One attempt a key against the newest version: ok, and the revision found. A
    deleted key has its tombstone's revision, so expecting none fails on it."""
    now = newest(log).select("key", F.col("rev").alias("current_rev"))
    return attempts.join(now, "key", "left").withColumn("ok", F.col("expected_rev").eqNullSafe(F.col("current_rev")))


def _fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Attempts in order of key and seq; only the revision of the key at hand is kept."""
    key, rev, begun = None, None, False
    for batch in it:
        out_ok, out_rev = [], []
        for k, seq, expected in zip(*(batch.column(c).to_pylist() for c in ("key", "seq", "expected_rev"))):
            if not begun or k != key:
                key, rev, begun = k, None, True
            ok = expected == rev
            rev = seq + 1 if ok else rev
            out_ok.append(ok)
            out_rev.append(rev)
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "seq": batch.column("seq"), "ok": pa.array(out_ok, pa.bool_()), "rev_after": pa.array(out_rev, pa.int64())})


def cas_fold(attempts: DataFrame) -> DataFrame:
    """Attempts (seq, key, expected_rev) one after another within each key from an empty
    store; an attempt that succeeds makes revision seq + 1. The outcome of one depends
    on those before it on the same key alone, so keys are folded side by side, each in
    one pass over its sorted attempts that holds a single revision."""
    ordered = attempts.select("key", F.col("seq").cast("long").alias("seq"), F.col("expected_rev").cast("long").alias("expected_rev")).repartition("key").sortWithinPartitions("key", "seq")
    return ordered.mapInArrow(_fold, "key string, seq long, ok boolean, rev_after long")


def tx_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("tx_id").agg(F.count("*").alias("ops"), F.min("rev").alias("first_rev"), F.max("rev").alias("last_rev"), F.countDistinct("key").alias("n_keys"))


def rev_runs(log: DataFrame, by: str, segment: int = 100_000) -> DataFrame:
    """Runs of consecutive revisions within each ``by``. Runs are found within segments of
    revisions; only those that touch a border go on to be joined across segments, so a
    frequent ``by`` is no single task's work."""
    rows = log.select(F.col(by).alias("by"), "rev", F.expr(f"rev div {segment}").alias("segment"))
    own = F.col("rev") - F.row_number().over(Window.partitionBy("by", "segment").orderBy("rev"))
    runs = rows.withColumn("run", own).groupBy("by", "segment", "run").agg(F.min("rev").alias("first_rev"), F.max("rev").alias("last_rev"), F.count("*").alias("n"))
    border = (F.col("first_rev") % segment == 0) | ((F.col("last_rev") + 1) % segment == 0)
    w = Window.partitionBy("by").orderBy("first_rev")
    starts = runs.filter(border).withColumn("starts", F.coalesce(F.lag("last_rev").over(w) + 1 != F.col("first_rev"), F.lit(True)).cast("long"))
    chained = starts.withColumn("chain", F.sum("starts").over(w)).groupBy("by", "chain").agg(F.min("first_rev").alias("first_rev"), F.max("last_rev").alias("last_rev"), F.sum("n").alias("n"))
    out = [F.col("by").alias(by), "first_rev", "last_rev", "n"]
    return runs.filter(~border).select(*out).union(chained.select(*out))
