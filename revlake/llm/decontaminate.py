"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
Every benchmark item gives its windows of ``width`` consecutive words, or all its
words as one window if it has fewer. Only the words of the benchmark matter: each
gets a number, a document's other words are 0, and a rolling hash over the numbers
finds windows whose words are all known. A hash that is found is verified word by
word, so a collision cannot count.

The broadcast set is bounded: the benchmark is cut into blocks of at most
``BLOCK_WINDOWS`` windows, each of which is one scan of the documents; their hits
are merged by a number of the row. The driver holds the texts of one block at a time;
executors make the index of windows from them, once a worker, as packed arrays. One
block holds a benchmark of about a million words; a longer item goes on in the next.

A null or empty text has no words and no hits. An empty benchmark, or one without
words, hits nothing. Items of one id count once, and so do all items without an id;
their windows hit words like any other's. Repeated documents are scanned alike, ids
may be null, texts of any length are scanned whole. Extra columns do not matter;
``decontaminate`` returns them as they are. The result is the same for every block size.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import ALNUM, batches, bounded_batches, changed, materialise

WIDTH = 8
BLOCK_WINDOWS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class WindowSet:
    """Windows of some items: word numbers, sorted hashes by window length, and who has them."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int = WIDTH):
        self.number: dict[bytes, int] = {}
        names: dict[str | None, int] = {}
        found: dict[int, list[tuple[int, np.ndarray]]] = {}
        for name, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], np.uint32)
            n = min(width, len(ids))
            if n:
                found.setdefault(n, []).append((names.setdefault(name, len(names)), np.lib.stride_tricks.sliding_window_view(ids, n)))
        self.items = list(names)
        self.by_length = []
        for n, windows in sorted(found.items()):
            keys = np.concatenate([w for _, w in windows])
            owner = np.repeat([k for k, _ in windows], [len(w) for _, w in windows]).astype(np.int32)
            hashes = hashed(keys)
            order = np.lexsort((owner, *keys.T, hashes))
            keys, owner, hashes = keys[order], owner[order], hashes[order]
            new = np.ones(len(keys), bool)  # where another window begins
            new[1:] = (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1]).any(axis=1)
            keep = new.copy()
            keep[1:] |= owner[1:] != owner[:-1]
            first = np.flatnonzero(new[keep])
            self.by_length.append((n, hashes[new], keys[new], owner[keep], np.append(first, keep.sum())))

    def owners(self, n: int, window: int) -> list[int]:
        """Items, by their place in ``items``, that have a window."""
        _, _, _, owner, first = next(x for x in self.by_length if x[0] == n)
        return owner[first[window] : first[window + 1]].tolist()

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window length: where known windows start, and which they are."""
        known = ids > 0
        for n, hashes, keys, *_ in self.by_length:
            if len(ids) < n:
                continue
            run = np.cumsum(known, dtype=np.int32)
            full = np.flatnonzero(run[n - 1 :] - np.concatenate([np.zeros(1, np.int32), run[: len(ids) - n]]) == n)
            if not len(full):
                continue
            window = ids[full[:, None] + np.arange(n)]
            looked = hashed(window)
            lo, hi = np.searchsorted(hashes, looked, "left"), np.searchsorted(hashes, looked, "right")
            for shift in range(int((hi - lo).max()) if len(lo) else 0):  # equal hashes stand together
                at = np.flatnonzero(lo + shift < hi)
                same = (keys[lo[at] + shift] == window[at]).all(axis=1)
                yield n, full[at[same]], lo[at[same]] + shift


def hashed(windows: np.ndarray) -> np.ndarray:
    """A hash of every row of word numbers."""
    out = np.zeros(len(windows), np.uint64)
    for column in windows.T:
        out = out * _BASE + column
    return out


@dataclass
class Hits:
    """What one text shares with the items."""

    n_words: int
    places: list[int] = field(default_factory=list)
    items: list[str | None] = field(default_factory=list)


def hits_of(windows: WindowSet, texts: list[bytes]) -> list[Hits]:
    split = [words(t) for t in texts]
    number = windows.number
    flat = [number.get(w, 0) for ws in split for w in ws]
    # A border no window crosses stands between documents.
    cuts = np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)
    ids = np.zeros(len(flat) + len(split), np.uint32)
    document = np.repeat(np.arange(len(split)), np.diff(cuts))
    ids[np.arange(len(flat)) + document] = flat
    covered = np.zeros(len(ids) + 1, np.int32)
    items: dict[int, set[int]] = {}
    begins = cuts[:-1] + np.arange(len(split))
    for n, at, which in windows.find(ids):
        np.add.at(covered, at, 1)
        np.add.at(covered, at + n, -1)
        who = np.searchsorted(begins, at, "right") - 1
        for d, k in set(zip(who.tolist(), which.tolist())):
            items.setdefault(d, set()).update(windows.owners(n, k))
    hit = np.cumsum(covered[:-1]) > 0
    out = []
    for d, ws in enumerate(split):
        own = Hits(len(ws))
        if d in items:
            lo = int(begins[d])
            own.places = np.flatnonzero(hit[lo : lo + len(ws)]).tolist()
            own.items = [windows.items[k] for k in sorted(items[d])]
        out.append(own)
    return out


@dataclass
class Block:
    """Texts of some items, sent to executors, which index them."""

    name: str
    width: int
    items: list[tuple[str | None, bytes]]


_indexed: dict[str, WindowSet] = {}


def index_of(block: Block) -> WindowSet:
    """The windows of a block; a worker keeps those of one block."""
    if block.name not in _indexed:
        _indexed.clear()
        _indexed[block.name] = WindowSet(block.items, block.width)
    return _indexed[block.name]


def _blocks(benchmark: DataFrame, width: int) -> Iterator[Block]:
    """The benchmark's items in blocks of a bounded number of words; one at least, which may be empty."""
    items, size, made = [], 0, 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        ws = words((r["t"] or "").encode())
        for lo in range(0, max(1, len(ws) - width + 1), BLOCK_WINDOWS):  # pieces share width - 1 words
            piece = ws[lo : lo + BLOCK_WINDOWS + width - 1]
            if items and size + len(piece) > BLOCK_WINDOWS:
                yield Block(uuid.uuid4().hex, width, items)
                items, size, made = [], 0, made + 1
            items.append((r["i"], b" ".join(piece)))
            size += len(piece)
    if items or not made:
        yield Block(uuid.uuid4().hex, width, items)


def _scan(shared, keep: bool):
    """Hits of every row (row, text), or of those that have any."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            found = hits_of(index_of(shared.value), texts)
            use = [k for k, h in enumerate(found) if keep or h.items]
            found = [found[k] for k in use]
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c).take(pa.array(use, pa.int32())) for c in batch.schema.names if c != "text"},
                "n_words": pa.array([h.n_words for h in found], pa.int64()),
                "hits": pa.array([h.places for h in found], pa.list_(pa.int64())),
                "items": pa.array([[i for i in h.items if i is not None] for h in found], pa.list_(pa.string())),
                "unnamed": pa.array([None in h.items for h in found], pa.bool_()),
            })

    return run


_FOUND = "n_words long, hits array<long>, items array<string>, unnamed boolean"


def _merged(numbered: DataFrame, first: Block, second: Block, rest: Iterator[Block]) -> DataFrame:
    """row, n_words, hits, items and unnamed of all blocks; one block is out at a time."""
    merged, keep = None, True
    for block in (first, second, *rest):
        shared = numbered.sparkSession.sparkContext.broadcast(block)
        part = materialise(numbered.mapInArrow(_scan(shared, keep), f"row long, {_FOUND}"))
        shared.destroy()
        merged, keep = part if merged is None else merged.unionByName(part), False
    distinct = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return merged.groupBy("row").agg(F.max("n_words").alias("n_words"), distinct("hits"), distinct("items"), F.bool_or("unnamed").alias("unnamed"))


def scan_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, hits (places of hit words, from 0), items (item_id as string of
    every item with an occurring window, null ids left out) and n_items (how many ids
    these are, null as one more)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = _blocks(benchmark, width)
    first, second = next(blocks), next(blocks, None)
    wanted = docs.select("doc_id", "text")
    if second is None:
        found = wanted.mapInArrow(_scan(spark.sparkContext.broadcast(first), True), f"doc_id {wanted.dtypes[0][1]}, {_FOUND}")
    else:
        numbered = materialise(wanted.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
        found = numbered.select("row", "doc_id").join(_merged(numbered.select("row", "text"), first, second, blocks), "row")
    return found.select("doc_id", "n_words", F.array_sort("hits").alias("hits"), "items", (F.size("items") + F.col("unnamed").cast("int")).alias("n_items"))


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut_words(text: str | None, places: list[int] | None) -> str | None:
    """``text`` without the words at ``places`` and what stands between adjacent ones."""
    if text is None or places is None:
        return text
    gone, out, at, before = set(places), [], 0, -2
    for k, m in enumerate(_WORD.finditer(text)):
        if k in gone:
            if before != k - 1:
                out.append(text[at : m.start()])
            at, before = m.end(), k
    out.append(text[at:])
    return "".join(out)


def _cut(batch: pa.RecordBatch, found: list[Hits], most_items: int) -> pa.RecordBatch:
    """Rows with fewer than ``most_items`` items, hit words cut out, n_chars to match."""
    use = [k for k, h in enumerate(found) if len(h.items) < most_items]
    hit = [k for k, j in enumerate(use) if found[j].places]
    batch = batch.take(pa.array(use, pa.int32()))
    if not hit:
        return batch
    text = batch.column("text").to_pylist()
    for k in hit:
        text[k] = cut_words(text[k], found[use[k]].places)
    values = {"text": pa.array(text, batch.schema.field("text").type)}
    if "n_chars" in batch.schema.names:
        n = batch.column("n_chars").to_pylist()
        for k in hit:
            n[k] = len(text[k])
        values["n_chars"] = pa.array(n, batch.schema.field("n_chars").type)
    return changed(batch, values)


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_items: int = 2, width: int = WIDTH) -> DataFrame:
    """``docs``, all columns, without documents that have windows of ``most_items`` items or
    more; of the others, hit words are cut out of the text and n_chars (a number) follows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = _blocks(benchmark, width)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        shared = spark.sparkContext.broadcast(first)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in batches(it):
                yield _cut(batch, hits_of(index_of(shared.value), texts), most_items)

        return docs.mapInArrow(run, docs.schema)
    # The user's columns stay inside one, beside which names cannot clash.
    numbered = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))
    found = _merged(numbered.select("row", F.col("doc.text").alias("text")), first, second, blocks)
    rows = numbered.join(found.select("row", "hits", F.when(F.col("unnamed"), F.concat("items", F.array(F.lit(None).cast("string")))).otherwise(F.col("items")).alias("items")), "row")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            hits = [Hits(0, sorted(p), i) for p, i in zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist())]
            doc = batch.column("doc")
            yield _cut(pa.RecordBatch.from_arrays(doc.flatten(), names=[f.name for f in doc.type]), hits, most_items)

    return rows.select("doc", "hits", "items").mapInArrow(cut, docs.schema)
