"""Views of a changelog: latest, as of a revision, history, merges and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, by: str = "rev") -> DataFrame:
    """The row of greatest revision for each key: a partial and a final aggregation."""
    others = [c for c in log.columns if c != "key"]
    return log.groupBy("key").agg(F.max_by(F.struct(*others), by).alias("_v")).select("key", "_v.*").select(*log.columns)


def latest(log: DataFrame, include_deleted: bool = False) -> DataFrame:
    view = newest(log)
    return view if include_deleted else view.filter(F.col("value").isNotNull())


def as_of(log: DataFrame, rev: int | None = None, include_deleted: bool = False) -> DataFrame:
    """The view at revision ``rev``; None: the latest one."""
    return latest(log if rev is None else log.filter(F.col("rev") <= rev), include_deleted)


def get(log: DataFrame, key: str, rev: int | None = None) -> DataFrame:
    """The live version of one key, or no row."""
    return as_of(log.filter(F.col("key") == key), rev)


def history(log: DataFrame) -> DataFrame:
    """Every version with its rank from the newest."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("rev"))))


def intervals(log: DataFrame) -> DataFrame:
    """The revisions [rev, next_rev) in which each version is visible."""
    return log.withColumn("next_rev", F.lead("rev").over(Window.partitionBy("key").orderBy("rev")))


def kway_merge(runs: list[DataFrame]) -> DataFrame:
    """Runs of (key, rev, value) merged: the greatest revision wins, on ties the later
    run; the others are counted as candidates."""
    every = reduce(DataFrame.unionByName, [r.withColumn("run_idx", F.lit(i)) for i, r in enumerate(runs)])
    rank = F.struct(F.coalesce("rev", F.lit(-1)).alias("r"), "run_idx")
    return every.groupBy("key").agg(F.max_by(F.struct("rev", "value", "run_idx"), rank).alias("w"), (F.count("*") - 1).alias("candidates")).select("key", "w.rev", "w.value", "w.run_idx", "candidates")


def candidates(runs: list[DataFrame]) -> DataFrame:
    """The versions that ``kway_merge`` passes over, as rows: key, rev, value, run_idx."""
    every = reduce(DataFrame.unionByName, [r.withColumn("run_idx", F.lit(i)) for i, r in enumerate(runs)])
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.coalesce("rev", F.lit(-1))), F.desc("run_idx")))
    return every.withColumn("rank", rank).filter("rank > 1").select("key", "rev", "value", "run_idx")


def multi_get(log: DataFrame, keys: DataFrame, rev: int | None = None) -> DataFrame:
    """The live value of every key of ``keys``, null where there is none. Only versions
    of wanted keys are aggregated."""
    wanted = log.join(keys.select("key").distinct(), "key", "left_semi")
    return keys.join(as_of(wanted, rev).select("key", "rev", "value"), "key", "left")


def asof_multi(log: DataFrame, probes: DataFrame) -> DataFrame:
    """For every (key, at_rev) the version of greatest revision not above: versions and
    probes are sorted together once and the last version carried forward."""
    versions = log.select("key", F.col("rev").alias("at"), F.lit(0).alias("probe"), F.struct("rev", "value").alias("v"))
    asked = probes.select("key", F.col("at_rev").alias("at"), F.lit(1).alias("probe"), F.lit(None).cast(versions.schema["v"].dataType).alias("v"))
    w = Window.partitionBy("key").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    found = versions.union(asked).withColumn("v", F.last("v", ignorenulls=True).over(w)).filter("probe = 1")
    return found.select("key", F.col("at").alias("at_rev"), "v.rev", "v.value")


def snapshot_diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """Keys whose live value differs between two revisions (an extension)."""
    touched = log.filter((F.col("rev") > old) & (F.col("rev") <= new)).select("key").distinct()
    a = multi_get(log, touched, old).select("key", F.col("value").alias("old_value"))
    b = multi_get(log, touched, new).select("key", F.col("value").alias("new_value"))
    return a.join(b, "key").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
