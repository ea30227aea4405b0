"""Watch and lease expiry on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from revlake.operators.watch import deliveries, matches

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New files of a log directory as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def matched(stream: DataFrame, subs: DataFrame) -> DataFrame:
    """Events with the subscriptions that they match and have not seen."""
    return stream.join(subs, matches()).filter(F.col("rev") > F.coalesce("last_seen_rev", F.lit(0))).select("id", "once", "key", "rev", "value")


def watch(stream: DataFrame, subs: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Call ``handler`` (deliveries, batch number) for every micro-batch. Delivery is at
    least once; (id, rev) identifies a delivery."""
    def batch(rows: DataFrame, number: int) -> None:
        handler(deliveries(rows, subs).filter(F.col("rev") > F.coalesce("last_seen_rev", F.lit(0))), number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


class FirstMatch(StatefulProcessor):
    """The first delivery of each subscription, of those that come in one trigger the one of least revision."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getValueState("fired", StructType([StructField("rev", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows]
        if not self.fired.exists() and frames:
            first = pd.concat(frames).sort_values("rev").head(1)
            self.fired.update((int(first["rev"].iloc[0]),))
            yield first[["id", "key", "rev"]]


def once_deliveries(stream: DataFrame, subs: DataFrame) -> DataFrame:
    return matched(stream, subs.filter("once")).groupBy("id").transformWithStateInPandas(FirstMatch(), "id long, key string, rev long", "Append", "None")


class Expiry(StatefulProcessor):
    """Keys of a lease, and a timer at its expiry that gives them out. A later expiry replaces the timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getMapState("keys", StructType([StructField("key", StringType())]), StructType([StructField("rev", LongType())]))
        self.until = handle.getValueState("until", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = self.until.get()[0] if self.until.exists() else None
        new = latest
        for frame in rows:
            for r in frame.itertuples():
                self.keys.updateValue((r.key,), (int(r.rev),))
                new = max(new or 0, int(r.lease_expires_at_ms))
        if new is not None and new != latest:
            if latest is not None:
                self.handle.deleteTimer(latest)
            self.until.update((new,))
            self.handle.registerTimer(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = sorted(k[0] for k in self.keys.keys())
        self.keys.clear()
        self.until.clear()
        yield pd.DataFrame({"lease_id": [int(key[0])] * len(gone), "key": gone, "expired_at_ms": [expiredTimerInfo.getExpiryTimeInMs()] * len(gone)})


def lease_expiry(stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(lease_id, key, expired_at_ms) when event time passes a lease's last expiry.
    ``stream`` has key, rev, created_at_ms, lease_id, lease_expires_at_ms."""
    timed = stream.filter(F.col("lease_id").isNotNull()).withColumn("at", F.timestamp_millis("created_at_ms")).withWatermark("at", delay)
    return timed.groupBy("lease_id").transformWithStateInPandas(Expiry(), "lease_id long, key string, expired_at_ms long", "Append", "EventTime")
