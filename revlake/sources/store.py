"""A directory of sorted runs under versioned manifests.

A flush writes one Parquet folder of files sorted by key, with bloom filters on it; each
file is a run. A new manifest version, created exclusively, then names what is there. A
writer that finds its version taken reads the newer one, applies its change to that and
tries again, so no flush is lost. Readers take the newest whole manifest: a run is seen
whole or not at all. What no manifest names stays for a retention, for readers that have
begun and writers that have not published yet.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revlake.operators import compact as pick
from revlake.operators import index
from revlake.operators.compact import RETENTION_MS, merge_history
from revlake.operators.views import newest

RUN = "file string, level long, min_key string, max_key string, max_rev long, size long, entries long, mark long, created_at_ms long"
_FIELDS = [c.split()[0] for c in RUN.split(", ")]
_create = threading.Lock()


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, codec: str = "zstd", row_group: int = 32 << 20, level_base: int = pick.LEVEL_BASE):
        self.spark, self.path, self.schema, self.codec, self.row_group, self.level_base = spark, path.rstrip("/"), schema, codec, row_group, level_base
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _list(self, name: str) -> list:
        p = self._path(name)
        return list(self._fs.listStatus(p)) if self._fs.exists(p) else []

    # Manifest ---------------------------------------------------------------------

    def _current(self) -> tuple[int, list[dict]]:
        """The newest whole manifest and its version; one that is still being written is passed over."""
        versions = sorted((int(s.getPath().getName()[:-5]) for s in self._list("manifest") if s.getPath().getName().endswith(".json")), reverse=True)
        for v in versions:
            file = self._fs.open(self._path(f"manifest/{v:012d}.json"))
            try:
                return v, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
            except ValueError:
                continue
            finally:
                file.close()
        return 0, []

    def _publish(self, change: Callable[[list[dict]], list[dict]], attempts: int = 50) -> None:
        for _ in range(attempts):
            version, runs = self._current()
            content, target = json.dumps(change(runs)).encode(), self._path(f"manifest/{version + 1:012d}.json")
            with _create:
                if self._fs.exists(target):
                    continue
                try:
                    out = self._fs.create(target, False)
                except Exception as e:  # noqa: BLE001  another writer was first
                    if "AlreadyExists" not in str(e):
                        raise
                    continue
                out.write(bytearray(content))
                out.close()
            return
        raise RuntimeError("the manifest changes too often")

    def runs(self) -> list[dict]:
        return self._current()[1]

    def batches(self) -> list[str]:
        """Folders that the manifest names."""
        return sorted({r["file"].split("/")[0] for r in self.runs()})

    def manifest(self) -> DataFrame:
        """A row for each run."""
        return self._frame(self.runs())

    def _frame(self, runs: list[dict]) -> DataFrame:
        return self.spark.createDataFrame([tuple(r[c] for c in _FIELDS) for r in runs], RUN)

    # Runs -------------------------------------------------------------------------

    def _write(self, rows: DataFrame, level: int, outputs: int | None = None) -> list[dict]:
        name = f"batch-{uuid.uuid4().hex}"
        ordered = (rows.repartitionByRange(outputs, "key") if outputs else rows.repartitionByRange("key")).sortWithinPartitions("key", "rev")
        writer = ordered.write.option("parquet.block.size", self.row_group).option("compression", self.codec)
        # Of filters from 1 MiB down to 32 bytes the smallest that suffices is kept: a run of a few keys is not 1 MiB.
        for option, value in (("enabled#key", "true"), ("adaptive.enabled", "true"), ("candidates.number#key", "16")):
            writer = writer.option(f"parquet.bloom.filter.{option}", value)
        writer.parquet(f"{self.path}/{name}")
        now = int(time.time() * 1000)
        stats = self._stats(self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}"))
        return [dict(zip(_FIELDS, (f"{name}/{r['file']}", level, r["min_key"], r["max_key"], r["max_rev"], r["size"], r["entries"], r["mark"], now))) for r in stats]

    def _stats(self, rows: DataFrame) -> list:
        """Key range, size, entries and a mark of the content of each file; a row a file."""
        mark = F.bit_xor(F.xxhash64(*self.schema.names))
        return rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("rev").alias("max_rev"), F.sum(pick.entry_bytes()).alias("size"), F.count("*").alias("entries"), mark.alias("mark")).collect()

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in files])

    def flush(self, rows: DataFrame) -> None:
        """Add the runs of one batch to level 0."""
        new = self._write(rows, 0)
        self._publish(lambda runs: [*runs, *new])

    def files(self, start: str | None = None, end: str | None = None) -> list[str]:
        """Runs whose keys meet [start, end)."""
        return [r["file"] for r in self.runs() if (start is None or r["max_key"] >= start) and (end is None or r["min_key"] < end)]

    def read(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """The log within [start, end), from the runs that meet it; bounds reach the scan as well."""
        rows = self._read(self.files(start, end))
        if start is not None:
            rows = rows.filter(F.col("key") >= start)
        return rows if end is None else rows.filter(F.col("key") < end)

    def get(self, key: str) -> DataFrame:
        """The live version of one key, from the runs whose range and bloom filters allow it."""
        view = newest(self._read(self.files(key, key + "\0")).filter(F.col("key") == key))
        return view.filter(F.col("value").isNotNull())

    def max_rev(self) -> int:
        """The revision to go on from, over everything that was published."""
        return max((r["max_rev"] or 0 for r in self.runs()), default=0)

    # Compaction -------------------------------------------------------------------

    def compact(self, active_rev: int | None = None) -> dict:
        """Rewrite all runs as one batch: the newest versions, or with ``active_rev`` all
        that snapshots from it on need."""
        return self._merge([r["file"] for r in self.runs()], 1, active_rev, None)

    def _merge(self, files: list[str], level: int, active_rev: int | None, limit: int | None) -> dict:
        chosen = [r for r in self.runs() if r["file"] in set(files)]
        size = sum(r["size"] or 0 for r in chosen)
        rows = self._read([r["file"] for r in chosen])
        kept = newest(rows) if active_rev is None else merge_history(rows, active_rev)
        # What is kept is cut, often a small part of what is read.
        left = (kept.agg(F.sum(pick.entry_bytes())).head()[0] or 0) if limit and chosen else 0
        new = self._write(kept, level, max(1, -(-left // limit)) if limit else None) if chosen else []
        gone = {r["file"] for r in chosen}

        def replace(runs: list[dict]) -> list[dict]:
            if not gone <= {r["file"] for r in runs}:
                raise RuntimeError("another compaction has replaced these runs")
            return [r for r in runs if r["file"] not in gone] + new

        self._publish(replace)
        return {"bytes_read": size, "bytes_written": sum(r["size"] for r in new), "files_created": len(new), "files_removed": len(gone), "moved": 0}

    def compact_level(self, level: int, active_rev: int | None = None, limit: int = 64 << 20) -> dict | None:
        """One step for a level above its target: runs that meet none of the next level move
        down as they are; others are merged with those they meet, and the result is cut at
        ``limit`` bytes. None where the level is within its target."""
        target, runs = self.level_base * pick.LEVEL_FACTOR**level, self.runs()
        if sum(r["size"] or 0 for r in runs if r["level"] == level) <= target:
            return None
        files = self._frame(runs)
        if level == 0:
            chosen = [r["file"] for r in pick.pick_level0(files).collect()]
        else:
            ranked = pick.pick_by_overlap(files, level, target, len(runs)).collect()
            mine = [r["file"] for r in ranked if r["place"] <= pick.MAX_FILES]
            free = {r["file"] for r in pick.promotable(files, level).collect()}
            if free & set(mine):  # moving costs nothing, so all that have to go do
                free &= {r["file"] for r in ranked}
                self._publish(lambda runs: [r | {"level": level + 1} if r["file"] in free else r for r in runs])
                return {"bytes_read": 0, "bytes_written": 0, "files_created": 0, "files_removed": 0, "moved": len(free)}
            below = pick.overlap_pairs(files).filter((F.col("level") == level) & F.col("file").isin(mine)).select("next_file").distinct()
            chosen = mine + [r["next_file"] for r in below.collect()]
        return self._merge(chosen, level + 1, active_rev, limit)

    def compact_levels(self, levels: int = 6, active_rev: int | None = None, limit: int = 64 << 20, bytes_per_second: float | None = None) -> dict:
        """Steps, upper levels first, until every level is within its target: every step takes
        bytes a level down, so they come to an end. ``bytes_per_second`` spaces them out; the
        figures of all steps are added up."""
        total = {"steps": 0, "bytes_read": 0, "bytes_written": 0, "files_created": 0, "files_removed": 0, "moved": 0}
        while True:
            began = time.monotonic()
            step = next((s for s in (self.compact_level(k, active_rev, limit) for k in range(levels)) if s is not None), None)
            if step is None:
                break
            total = {k: total[k] + step.get(k, 1) for k in total}
            if bytes_per_second:
                time.sleep(max(0.0, step["bytes_written"] / bytes_per_second - (time.monotonic() - began)))
        return total

    def background(self, seconds: float, done: Callable[[dict], None] | None = None, **options) -> Callable[[], None]:
        """Compact again and again in a thread of the driver; the result stops it. Errors go to ``done``."""
        stop = threading.Event()

        def loop() -> None:
            while not stop.wait(seconds):
                try:
                    figures = self.compact_levels(**options)
                except Exception as e:  # noqa: BLE001
                    figures = {"error": str(e)}
                if done:
                    done(figures)

        thread = threading.Thread(target=loop, daemon=True)
        thread.start()

        def end() -> None:
            stop.set()
            thread.join()

        return end

    def vacuum(self, retention_ms: int = RETENTION_MS) -> int:
        """Delete folders that the manifest does not name and that are older than the retention; how many."""
        known, gone, before = set(self.batches()), 0, time.time() * 1000 - retention_ms
        for status in self._list(""):
            name = status.getPath().getName()
            if name.startswith("batch-") and name not in known and status.getModificationTime() <= before:
                self._fs.delete(status.getPath(), True)
                gone += 1
        newest_version = self._current()[0]
        for status in self._list("manifest"):
            name = status.getPath().getName()
            if name.endswith(".json") and int(name[:-5]) < newest_version and status.getModificationTime() <= before:
                self._fs.delete(status.getPath(), False)
        return gone

    # Damage -----------------------------------------------------------------------

    def damaged(self) -> list[dict]:
        """Runs that are missing, cannot be read, or hold something else than was written."""
        runs, found = self.runs(), {}
        present = [r for r in runs if self._fs.exists(self._path(r["file"]))]
        if present:
            rows = self.spark.read.schema(self.schema).option("ignoreCorruptFiles", "true").parquet(*[f"{self.path}/{r['file']}" for r in present])
            found = {s["file"]: (s["entries"], s["mark"]) for s in self._stats(rows)}
        return [r for r in runs if found.get(r["file"].split("/")[1]) != (r["entries"], r["mark"])]

    def repair(self, log: DataFrame | None = None) -> int:
        """Put damaged runs aside. What the log has of their key ranges, up to their last
        revision, takes their place; without a log they are only put aside. How many."""
        bad = self.damaged()
        for run in bad:
            new = []
            if log is not None:
                rows = log.filter(F.col("key").between(run["min_key"], run["max_key"]) & (F.col("rev") <= run["max_rev"])).select(*self.schema.names)
                new = self._write(rows, run["level"])
            self._publish(lambda runs: [r for r in runs if r["file"] != run["file"]] + new)  # noqa: B023
            source = self._path(run["file"])
            if self._fs.exists(source):
                aside = self._path(f"quarantine/{run['file'].replace('/', '-')}")
                self._fs.mkdirs(aside.getParent())
                self._fs.rename(source, aside)
        return len(bad)

    # Index ------------------------------------------------------------------------

    def build_index(self) -> str:
        """Write the trigram postings of all keys, sorted by gram, and name them; where they are."""
        name = f"postings-{uuid.uuid4().hex}"
        rows = index.postings(self.read().select("key").distinct())
        rows.repartitionByRange("gram").sortWithinPartitions("gram", "key").write.parquet(f"{self.path}/{name}")
        return f"{self.path}/{name}"

    def contains(self, postings: str, pattern: str) -> DataFrame:
        """Keys that contain ``pattern``, by the postings written before; the grams reach the scan."""
        return index.contains(self.spark.read.parquet(postings), self.read().select("key").distinct(), pattern)
