"""A log of records in segments of text lines, each with a check value.

A line is the CRC-32 of its JSON in hex digits, a space, and the JSON. Segments are
folders named by the first revision they hold; appending writes a new one, which is what
rotation comes to. Within a segment every line has its place; reading stops at the first
one that is damaged or missing, so a torn tail is never taken for data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "key string, rev bigint, value string, created_at_ms bigint, lease_id bigint, lease_expires_at_ms bigint"
_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the segments in a folder, of any number of files by one call to the JVM."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    listed = jvm.org.apache.commons.lang3.ArrayUtils.toString(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(root)))
    return re.findall(r"/(segment[-=]\d+)(?=[,}])", listed)


def _folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    return sorted((int(n[8:]), f"{path}/{n}") for n in _names(spark, path) if n[7] == "-")


def append(log: DataFrame, path: str, segment_rows: int = 1_000_000, codec: str = "none") -> None:
    """Write ``log`` as segments of ``segment_rows`` revisions each. ``codec``: none, gzip, deflate, snappy, lz4, bzip2."""
    segment = F.expr(f"rev - pmod(rev - 1, {segment_rows})")
    body = F.to_json(F.struct(*_NAMES))
    rows = log.select(segment.alias("segment"), "rev", F.to_json(F.struct((F.row_number().over(Window.partitionBy(segment).orderBy("rev")) - 1).alias("place"), body.alias("body"))).alias("json"))
    lines = rows.select("segment", "rev", F.concat(F.lpad(F.hex(F.crc32("json")), 8, "0"), F.lit(" "), "json").alias("value"))
    ordered = lines.repartitionByRange("segment").sortWithinPartitions("segment", "rev").select("segment", "value")
    target = f"{path}/.writing"
    # Tasks move their files to their places themselves; what a failed run leaves there is never read.
    ordered.write.mode("overwrite").partitionBy("segment").option("compression", codec).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(target)
    spark = log.sparkSession
    new = spark._jvm.org.apache.hadoop.fs.Path  # looked up once: every look-up is several calls
    fs = new(target).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in _names(spark, target):  # a segment appears whole, by rename
        if not fs.rename(new(f"{target}/{name}"), new(f"{path}/segment-{int(name[8:]):020d}")):
            raise FileExistsError(name)
    fs.delete(new(target), True)


def read(spark: SparkSession, path: str, from_rev: int | None = None) -> DataFrame:
    """Records up to the first damaged line of each segment, from the segments that reach ``from_rev``."""
    folders = every = _folders(spark, path)
    if from_rev is not None:
        later = [first for first, _ in folders if first <= from_rev]
        folders = [f for f in folders if f[0] >= (max(later) if later else 0)]
    if not folders:
        return spark.createDataFrame([], RECORD)
    lines = _lines(spark, f"{path}/segment-*" if folders == every else [f for _, f in folders])
    json = F.substring("value", 10, 2**30)
    good = F.coalesce((F.substring("value", 1, 8) == F.lpad(F.hex(F.crc32(json)), 8, "0")) & (F.substring("value", 9, 1) == " "), F.lit(False))
    parsed = lines.select("segment", good.alias("good"), F.when(good, F.from_json(json, "place bigint, body string")).alias("r")).select("segment", "good", "r.place", "r.body")
    # Places that are there, from 0 on without a gap: as many as their number among the sorted ones.
    valid = parsed.filter("good").withColumn("n", F.row_number().over(Window.partitionBy("segment").orderBy("place")) - 1).filter("n = place")
    rows = valid.select(F.from_json("body", RECORD).alias("r")).select("r.*")
    return rows if from_rev is None else rows.filter(F.col("rev") >= from_rev)


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """For each segment its lines, how many are readable in a row from the first, and their bytes."""
    if not _folders(spark, path):
        return spark.createDataFrame([], "segment bigint, lines bigint, bytes bigint")
    lines = _lines(spark, f"{path}/segment-*")
    return lines.groupBy("segment").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).cast("long").alias("bytes"))


def repair(spark: SparkSession, path: str) -> int:
    """Rewrite segments that hold lines which cannot be read, up to the first of these; how many.
    One pass finds them and one more rewrites them, whatever the number of segments."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    fs = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = dict(_folders(spark, path))
    if not folders:
        return 0
    read = _placed(_lines(spark, f"{path}/segment-*")).groupBy("segment").agg(F.count("*").alias("lines"), F.count_if("kept").alias("kept"))
    bad = sorted(r["segment"] for r in read.filter("lines <> kept").select("segment").collect())
    if not bad:
        return 0
    target = f"{path}/.mending"
    kept = _placed(_lines(spark, [folders[first] for first in bad])).filter("kept")
    kept.repartition("segment").sortWithinPartitions("segment", "place").select("segment", "value").write.mode("overwrite").partitionBy("segment").text(target)
    for first in bad:
        mended, old = new(f"{target}/segment={first}"), new(folders[first])
        if not fs.exists(mended):  # no line of it can be read
            fs.mkdirs(mended)
        fs.rename(old, new(f"{path}/.damaged-{first}"))
        fs.rename(mended, old)
    fs.delete(new(target), True)
    return len(bad)


def _lines(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """The lines of segments with the segment they are of."""
    return spark.read.text(folders).select(F.regexp_extract("_metadata.file_path", r"segment-(\d+)", 1).cast("long").alias("segment"), "value")


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with their places, and whether they are kept: those up to the first damaged one of each segment."""
    json = F.substring("value", 10, 2**30)
    good = F.coalesce(F.substring("value", 1, 8) == F.lpad(F.hex(F.crc32(json)), 8, "0"), F.lit(False))
    placed = lines.withColumn("good", good).withColumn("place", F.when(F.col("good"), F.get_json_object(json, "$.place").cast("long")))
    n = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("good"), "place")) - 1
    return placed.withColumn("kept", F.coalesce(F.col("good") & (n == F.col("place")), F.lit(False)))


def truncate(spark: SparkSession, path: str, rev: int) -> int:
    """Delete whole segments whose revisions are all up to ``rev``; how many."""
    old = spark._jvm.org.apache.hadoop.fs.Path
    fs = old(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = _folders(spark, path)
    gone = [folder for (_, folder), (following, _) in zip(folders, folders[1:]) if following <= rev + 1]
    for folder in gone:
        fs.delete(old(folder), True)
    return len(gone)
