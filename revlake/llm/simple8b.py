"""Token ids in Simple-8b files: word-aligned variable packing with vectorised decoding.

A 64-bit word holds a 4-bit selector and 60 bits of payload. The selector says
how many values the word packs and in how many bits each; selector 15 is an
escape, whose next word is one value of up to 64 bits, as it is. A packed array is cut into
blocks of ``BLOCK`` values, and a block table keeps the word where each block
starts, so any range of values decodes without reading what precedes it.

A token file is a Parquet part whose rows are segments in ascending document
order. A segment holds whole documents: their ids, their token counts (packed as
well), the packed tokens and the block table. Files live wherever Spark writes.

Ties in doc_id keep both documents, ordered by text; null ids come first; a null
text is an empty one, which consists of the end id alone; an empty table has no segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.llm.bpe import default_vocabulary
from revlake.llm.bpe_arrays import array_encoder
from revlake.llm.common import batches, bounded_batches

#: Fixed values: (values in a word, bits of each) by selector; 15 is the escape.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30)]
ESCAPE = 15
BLOCK = 1 << 16
#: Bytes of text whose tokens make one segment, if more than one document.
SEGMENT_BYTES = 2 << 20
#: Pieces that the encoder remembers.
REMEMBERED = 450_000


def _fits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the selector that packs most of the values from there on, and how many."""
    n = len(values)
    best = np.full(n, ESCAPE, np.uint8)
    count = np.ones(n, np.int64)
    for selector in range(len(SELECTORS) - 1, -1, -1):
        k, bits = SELECTORS[selector]
        inside, size = values < (1 << bits) if bits else values == 0, 1
        while size < k <= n and inside.any():  # whether the next k values are all small, by doubling
            size, more = min(k, 2 * size), min(k, 2 * size) - size
            inside = inside[:-more] & inside[more:]
        if size == k:
            at = np.flatnonzero(inside)
            best[at], count[at] = selector, k
    # 30-bit pairs need two values; a last single value below 2^60 takes a pair with a zero,
    # which the known number of values cuts off.
    return best, count


def encode_block(values: np.ndarray) -> np.ndarray:
    """Packed words of one block (at most BLOCK unsigned values)."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([values, np.zeros(1, np.uint64)])  # so that one value alone can be half a pair
    best, count = _fits(padded)
    step, starts, at = count.tolist(), [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    kinds = best[starts]
    places = np.cumsum(1 + (kinds == ESCAPE)) - 1 - (kinds == ESCAPE)
    words = np.zeros(int(places[-1]) + 1 + int(kinds[-1] == ESCAPE), np.uint64)
    words[places] = kinds.astype(np.uint64) << np.uint64(60)
    for selector, (k, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(kinds == selector)
        if bits and len(mine):
            block = padded[starts[mine][:, None] + np.arange(k)]
            words[places[mine]] |= np.bitwise_or.reduce(block << (np.arange(k) * bits).astype(np.uint64), axis=1)
    escaped = np.flatnonzero(kinds == ESCAPE)
    words[places[escaped] + 1] = padded[starts[escaped]]
    return words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values that ``encode_block`` packed."""
    if not n:
        return np.zeros(0, np.uint64)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (kinds == ESCAPE).any():  # what follows an escape is a value, even if it looks like an escape
        for i in np.flatnonzero(kinds == ESCAPE).tolist():
            if not raw[i] and i + 1 < len(words):
                raw[i + 1] = True
    counts = np.array([k for k, _ in SELECTORS] + [1], np.int64)[kinds]
    counts[raw] = 0
    ends = np.cumsum(counts)
    out = np.zeros(max(int(ends[-1]), n), np.uint64)
    for selector, (k, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero((kinds == selector) & ~raw)
        if bits and len(mine):
            values = (words[mine][:, None] >> (np.arange(k) * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
            out[(ends[mine] - k)[:, None] + np.arange(k)] = values
    mine = np.flatnonzero((kinds == ESCAPE) & ~raw)
    out[ends[mine] - 1] = words[mine + 1]
    return out[:n]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """The packed words and the block table (first word of each block) of any number of values."""
    parts = [encode_block(values[i : i + BLOCK]) for i in range(0, len(values), BLOCK)]
    table = np.cumsum([0, *map(len, parts)]).astype("<u8")
    return b"".join(p.astype("<u8").tobytes() for p in parts), table.tobytes()


def unpack(words: bytes, table: bytes, n: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Values lo..hi of ``n`` packed ones; only the blocks that hold them are decoded."""
    data, starts = np.frombuffer(words, "<u8"), np.frombuffer(table, "<u8").astype(np.int64)
    hi = n if hi is None else min(hi, n)
    if lo >= hi:
        return np.zeros(0, np.uint64)
    first, last = lo // BLOCK, (hi - 1) // BLOCK
    parts = [decode_block(data[starts[b] : starts[b + 1]], min(BLOCK, n - b * BLOCK)) for b in range(first, last + 1)]
    return np.concatenate(parts)[lo - first * BLOCK : hi - first * BLOCK]


SEGMENT = "part int, seq long, before long, docs long, tokens long, doc_ids binary, null_ids long, counts binary, count_table binary, words binary, table binary"


def _segments(vocabulary: str | None, end_id: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq, before = array_encoder(vocabulary or default_vocabulary(), REMEMBERED), TaskContext.get().partitionId(), 0, 0
        for batch, texts in batches(it, SEGMENT_BYTES):
            ids, counts = enc.encode(texts, end_id)
            doc_ids = batch.column("doc_id")
            (words, table), (packed, count_table) = pack(ids), pack(counts)
            row = [part, seq, before, len(counts), len(ids), doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), doc_ids.null_count, packed, count_table, words, table]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()])], names=[c.split()[0] for c in SEGMENT.split(", ")])
            seq, before = seq + 1, before + len(ids)

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, partitions: int | None = None) -> None:
    """Encode ``docs`` and write its token files to ``path`` in ascending doc_id order.

    One range shuffle of the texts puts documents in order; each task then writes
    its own segments, so memory is bounded by a segment and the longest text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.crc32("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(vocabulary, end_id), SEGMENT).write.parquet(path)


def _read_back(starts: dict[int, int]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                counts = unpack(r["counts"], r["count_table"], r["docs"]).astype(np.int64)
                ids = unpack(r["words"], r["table"], r["tokens"]).astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(counts)])
                view, at = memoryview(ids.tobytes()), (4 * cuts).tolist()
                doc_ids = np.frombuffer(r["doc_ids"], "<i8")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, mask=np.arange(len(doc_ids)) < r["null_ids"]),
                    "start": pa.array(starts[r["part"]] + r["before"] + cuts[:-1]),
                    "n_tokens": pa.array(counts),
                    "ids_crc32": pa.array([zlib.crc32(view[a:b]) for a, b in zip(at, at[1:])], pa.int64()),
                })

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids_crc32 of the files at ``path``."""
    files = spark.read.schema(SEGMENT).parquet(path)
    # One row per written part: a few thousand numbers, whatever the corpus.
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part], at = at, at + totals[part]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    return files.mapInArrow(_read_back(starts), "doc_id long, start long, n_tokens long, ids_crc32 long")
