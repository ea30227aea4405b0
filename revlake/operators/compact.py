"""Runs, manifests and compaction as batch operators.

A manifest row describes one sorted run: file, level, min_key, max_key, size,
entries, created_at_ms. Manifests are metadata of files, a few rows for each
hundred megabytes, so plans over them may use one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL_BASE, LEVEL_FACTOR, MAX_FILES, MAX_RUN_BYTES = 16_384, 10, 20, 16_384
RETENTION_MS = 86_400_000


def varint_length(x: Column) -> Column:
    """Bytes of an unsigned varint: one for each started group of seven bits."""
    return F.when(x < 1, 1).otherwise(F.floor((F.length(F.bin(x)) + 6) / 7)).cast("long")


def entry_bytes() -> Column:
    """Size of one entry of a run: lengths, key, value, revision and two small numbers."""
    return (F.lit(4) + F.octet_length("key") + 4 + F.coalesce(F.octet_length("value"), F.lit(0)) + varint_length(F.col("rev")) + 2).cast("long")


def manifest(log: DataFrame, file: str, level: Column) -> DataFrame:
    """What a flush of each ``file`` group writes about it."""
    return log.groupBy(F.col(file).alias("file"), level.cast("long").alias("level")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum(entry_bytes()).alias("size"), F.count("*").alias("entries"), F.max("created_at_ms").alias("created_at_ms"))


def overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.max_key") >= F.col(f"{b}.min_key")) & (F.col(f"{a}.min_key") <= F.col(f"{b}.max_key"))


def overlap_pairs(files: DataFrame) -> DataFrame:
    """Pairs of a run and a run of the next level whose key ranges meet."""
    a, b = files.alias("a"), files.alias("b")
    return a.join(b, (F.col("b.level") == F.col("a.level") + 1) & overlaps("a", "b")).select(F.col("a.file").alias("file"), F.col("a.level").alias("level"), F.col("b.file").alias("next_file"))


def replace(files: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    return files.join(removed.select("file"), "file", "left_anti").unionByName(added)


def pick_level0(files: DataFrame, target: int | None = None, most: int = MAX_FILES) -> DataFrame:
    """The first ``most`` level-0 runs and the level-1 runs that meet any level-0 run;
    nothing where the level is within its target."""
    zero = files.filter("level = 0")
    if target is not None:
        zero = zero.withColumn("total", F.sum("size").over(Window.partitionBy("level"))).filter(F.col("total") > target).drop("total")
    first = zero.orderBy("file").limit(most)
    one = files.filter("level = 1").alias("b").join(zero.alias("a"), overlaps("a", "b"), "left_semi")
    return first.select("file", "level").union(one.select("file", "level"))


def pick_by_overlap(files: DataFrame, level: int, target: int, most: int = MAX_FILES) -> DataFrame:
    """Runs of a level to compact until it is within ``target``: by overlap with the next
    level over size, then smallest first; at most ``most``."""
    mine = files.filter(F.col("level") == level)
    count = overlap_pairs(files).filter(F.col("level") == level).groupBy("file").agg(F.count("*").alias("overlap"))
    scored = mine.join(count, "file", "left").select("file", "size", F.coalesce("overlap", F.lit(0)).alias("overlap"))
    all_ = Window.partitionBy()
    needed = F.greatest(F.lit(1), F.sum("size").over(all_) - target)
    # One order serves both rules: files without overlap follow by size.
    order = Window.orderBy(F.desc(F.col("overlap") / F.greatest(F.lit(1), "size")), F.desc("overlap"), "size", "file")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = scored.withColumn("needed", needed).withColumn("total", F.sum("size").over(all_)).withColumn("before", before).withColumn("place", F.row_number().over(order))
    return ranked.filter((F.col("total") > target) & (F.col("before") < F.col("needed")) & (F.col("place") <= most)).select("file", "size", "overlap", F.col("place").cast("long").alias("place"))


def pick_window(files: DataFrame, level: int, needed: int, most: int = MAX_FILES) -> DataFrame:
    """The neighbouring runs, at most ``most``, of least total size that is enough."""
    w = Window.orderBy("min_key", "file")
    mine = files.filter(F.col("level") == level).withColumn("at", F.row_number().over(w))
    ends = mine.withColumn("sums", F.array(*[F.sum("size").over(w.rowsBetween(0, k)) for k in range(most)])).withColumn("left", F.count("*").over(Window.partitionBy()) - F.col("at") + 1)
    first = ends.select("at", "file", F.posexplode("sums").alias("k", "total"), "left").filter((F.col("total") >= needed) & (F.col("k") < F.col("left")))
    shortest = first.groupBy("at", "file").agg(F.min(F.struct("k", "total")).alias("e")).select(F.col("file").alias("first_file"), "at", (F.col("e.k") + 1).cast("long").alias("n_files"), F.col("e.total").alias("total"))
    return shortest.orderBy("total", "at").limit(1).drop("at")


def promotable(files: DataFrame, level: int) -> DataFrame:
    """Runs that meet none of the next level and can move down as they are."""
    mine, below = files.filter(F.col("level") == level).alias("a"), files.filter(F.col("level") == level + 1).alias("b")
    return mine.join(below, overlaps("a", "b"), "left_anti")


def merge(rows: DataFrame, now: int | None = None, retention_ms: int | None = RETENTION_MS, active_rev: int | None = None, promote: bool = False) -> DataFrame:
    """The newest version of each key. A tombstone stays while a reader at ``active_rev``
    may need it, or while its run (created_at_src) is younger than the retention; an
    expired one goes, or with ``promote`` gives way to the newest older value."""
    picked = rows.groupBy("key").agg(
        F.max_by(F.struct("rev", "value", "created_at_src"), "rev").alias("w"),
        F.max_by(F.struct("rev", "value", "created_at_src"), F.when(F.col("value").isNotNull(), F.col("rev"))).alias("c"),
    )
    dead = F.col("w.value").isNull()
    if now is None or retention_ms is None:
        gone = F.lit(False)
    else:
        gone = dead & F.coalesce(F.lit(now) - F.col("w.created_at_src") > retention_ms, F.lit(False))
    if active_rev is not None:
        gone = gone & (F.col("w.rev") > active_rev)
    old = F.col("c.value").isNotNull() if promote else F.lit(False)
    kept = F.when(~gone, F.col("w")).when(old, F.col("c"))
    return picked.select("key", kept.alias("k")).filter(F.col("k").isNotNull()).select("key", "k.rev", "k.value")


def merge_history(rows: DataFrame, active_rev: int) -> DataFrame:
    """The newest version not above ``active_rev`` of each key and every newer one, so
    that snapshots from ``active_rev`` on stay exact."""
    floor = rows.filter(F.col("rev") <= active_rev).groupBy("key").agg(F.max("rev").alias("floor"))
    return rows.join(floor, "key", "left").filter(F.col("rev") >= F.coalesce("floor", F.lit(0))).drop("floor")


def split_by_size(rows: DataFrame, by: str, limit: int = MAX_RUN_BYTES) -> DataFrame:
    """Entries of each ``by`` group in key order cut greedily into outputs of at most
    ``limit`` bytes; an entry that is larger has one of its own. One pass over the sorted
    entries holds the output at hand."""
    kind = rows.schema[by].dataType.simpleString()
    ordered = rows.select(F.col(by).alias("by"), "key", "rev", entry_bytes().alias("size")).repartition("by").sortWithinPartitions("by", "key", "rev")
    names = ("by", "part", "min_key", "max_key", "size", "entries")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list | None = None
        for batch in it:
            done, kind = [], batch.schema.field("by").type
            for group, key, size in zip(*(batch.column(c).to_pylist() for c in ("by", "key", "size"))):
                if at is not None and at[0] == group and at[4] + size <= limit:
                    at[3], at[4], at[5] = key, at[4] + size, at[5] + 1
                    continue
                if at is not None:
                    done.append(at)
                at = [group, at[1] + 1 if at is not None and at[0] == group else 0, key, key, size, 1]
            if done:
                yield _columns(done, kind)
        if at is not None:
            yield _columns([at], kind)

    def _columns(done: list[list], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=list(names))

    return ordered.mapInArrow(run, f"by {kind}, part long, min_key string, max_key string, size long, entries long").withColumnRenamed("by", by)


def level_targets(levels: int, base: int = LEVEL_BASE, factor: int = LEVEL_FACTOR) -> list[int]:
    return [base * factor**i for i in range(levels)]


def bloom_bits(average_key_bytes: Column) -> Column:
    """Bloom bits a key by key length, from 6 to 18."""
    return F.greatest(F.lit(6), F.least(F.lit(18), F.round(average_key_bytes / 8) + 6)).cast("long")


def file_bytes(blocks: Column, keys: Column, key_bytes: Column, bits: int = 10) -> Column:
    """Size of a run's file: header, blocks, an index entry for each key, the bloom filter and the footer."""
    return (F.lit(5) + blocks + key_bytes + keys * 12 + F.ceil(keys * bits / 8) + 28).cast("long")
