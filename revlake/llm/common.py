"""Shared helpers of the document operators.

An operator that reports on documents selects doc_id and text by name and ignores all
other columns. One that returns documents passes whole rows through Arrow and changes
values in place, so no name of its own stands beside the user's columns. Python stages
run in Arrow batches whose row count and bytes are both bounded, so a run of very long
texts cannot fill a worker.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: Rows of a decoded batch of a Parquet scan: with whole texts, the usual 4096 are arrays of many MiB.
READ_ROWS = 512
#: Bytes that a Parquet writer of intermediate tables holds before it writes them out.
ROW_GROUP = 16 << 20

#: UTF-8 bytes with A-Z lower-cased and nothing else changed.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, with every ASCII byte that is no letter or digit made a space.
ALNUM = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, and the rows that a scan decodes at once; very long texts make smaller batches."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="revlake-")  # a single process, as in tests
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/revlake-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    path = shared_dir(df.sparkSession)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(it: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of the batches with at most ``most`` bytes of text, or one row."""
    for batch in it:
        sizes = np.cumsum([0, *pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + most, side="right")) - 1)
            piece = batch.slice(lo, hi - lo)
            yield piece, as_bytes(piece.column("text"))
            lo = hi


def changed(batch: pa.RecordBatch, values: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with other values in some of its columns."""
    return pa.RecordBatch.from_arrays([values.get(c, batch.column(k)) for k, c in enumerate(batch.schema.names)], names=batch.schema.names)


#: Parts of a vector that are added up apart.
PIECES = 16


def add_up(frame: DataFrame, total: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """The sum of what ``total`` makes of each partition, one vector of doubles. Tasks send
    ``PIECES`` packed rows each, which other tasks add up, so the driver receives one vector."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = total(it)
        if vector is not None:
            parts = np.array_split(np.asarray(vector, np.float64), PIECES)
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(PIECES), pa.int32()), "v": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(v)
        if sums:
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.int32()), "v": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    kind = "k int, v binary"
    rows = frame.mapInArrow(run, kind).repartition(PIECES, "k").mapInArrow(add, kind).collect()
    return np.concatenate([np.frombuffer(r["v"]) for r in sorted(rows, key=lambda r: r["k"])]) if rows else None


#: Rows that a join may broadcast (a few longs each); beyond that it shuffles.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def held_out(modulus: int, remainder: int):
    """True for the rows whose labels or texts no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))
