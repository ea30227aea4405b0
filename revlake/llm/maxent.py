"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Words are runs of non-space bytes, A-Z lower-cased; an end token closes each text.
The probability of a word is that of its class given the words before, times that
of the word in its class. Classes are the most frequent words, the most frequent
endings, a few hashed groups of the other endings, the end token, and *repeat* (the
word before once more, certain within its class). The class softmax sums weights of
hashed features of the three classes before: n-grams and skips. Inside its class a
word starts from the smoothed share of its count, times the exponential of the weight
of one hashed feature of words: that of the word before and the word (n-gram), or,
where the word before has a class of its own (it is very frequent), of the word two
places before and the word (skip). The normaliser of a context and class is a sum over
the words that have a feature there. What the repeat class takes is not given to the
same words again, and the shares of words outside ``FREQUENT`` are left out of
normalisers, so probabilities add up to at most one.

*Training.* Word counts, (context, class) counts and word pairs of all training
documents are added up by Spark. Class weights take gradient rounds over the context
table: each task sums the gradient of its contexts, Spark adds the tasks' rows, the
driver updates ``HASHED`` x ``CLASSES`` weights, and the best round is kept. Word
features are pairs seen ``LEAST_PAIR`` times; as a context switches on one family, the
gradient of a discounted pair count vanishes at weights that one pass finds, each part
of the contexts by itself. Their table grows with the corpus and stays distributed.

*Scoring.* Contexts are looked up in numpy batches. Counts of the ``FREQUENT`` most
frequent words (a bounded table) are broadcast; other words meet their counts in a
join by word hash. Pairs whose context may have features (a bitmap of fixed size tells)
go, packed, to the part of their context, and sums return to their documents by row
number. Documents are read twice for that, so ``docs`` must give its rows in the same
order each time, as a table does. No context has more than one token in 21: words more
frequent than the 20 classes of their own are no context.

Null text is an empty one: only the end token. Repeated rows are scored alike; null
ids count as training documents. Without training documents every count is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import LOWER, batches, bounded_batches, held_out, materialise

CLASSES = 64
END, REPEAT = 0, 1
#: Words and endings with a class of their own, and groups of the other endings.
WORD_CLASSES, ENDING_CLASSES, GROUPS = 20, 34, 8
#: Coarse groups of the class three places before.
COARSE = 8
CONTEXTS = CLASSES * CLASSES * COARSE
HASHED = 8192
ROUNDS = 12
#: Words whose counts are broadcast, at most (16 bytes each).
FREQUENT = 300_000
#: Entries of a task's table of words before it is written out or emptied.
TABLE = 500_000
END_HASH = 0
#: The first class of endings: its words and those of later classes have word features.
FIRST = 2 + WORD_CLASSES
#: Times a pair is seen to have a feature.
LEAST_PAIR = 2
#: Training tokens of a part of the contexts, about, and tokens a task packs at a time.
PART_TOKENS, PACK = 1_000_000, 1_000_000
#: Bits of a slot's number in the bitmap of contexts that have features.
SLOT_BITS = 26
#: Cells of the class table that one part adds up.
CHUNK = CONTEXTS * CLASSES // 16


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def word_hash(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w) - 2**63


def ending(w: bytes) -> int:
    """The last two bytes as a number; the end token has none (-1)."""
    return int.from_bytes(w[-2:], "little")


def _count_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words = list(tally)
        out = pa.RecordBatch.from_pydict({"h": pa.array([word_hash(w) for w in words], pa.int64()), "e": pa.array([ending(w) for w in words], pa.int32()), "n": pa.array([tally[w] for w in words], pa.int64())})
        tally.clear()
        return out

    documents = 0
    for batch, texts in batches(it):
        documents += len(texts)
        for t in texts:
            tally.update(tokens(t))
        if len(tally) > TABLE:
            yield flush()
    if tally:
        yield flush()
    if documents:
        yield pa.RecordBatch.from_pydict({"h": pa.array([END_HASH], pa.int64()), "e": pa.array([-1], pa.int32()), "n": pa.array([documents], pa.int64())})


@dataclass
class Vocabulary:
    """Classes and counts; all of bounded size."""

    total: int
    distinct: int
    class_of_word: dict[int, int]  # by hash
    class_of_ending: np.ndarray
    class_total: np.ndarray
    class_distinct: np.ndarray
    hashes: np.ndarray  # sorted, of frequent words
    counts: np.ndarray
    short: np.ndarray  # class and short hash of frequent words, sorted
    share: np.ndarray  # their share of the class

    @property
    def bits(self) -> int:
        """Leading bits of a context that name its part."""
        return max(4, min(20, (self.total // PART_TOKENS).bit_length()))

    @property
    def inside(self) -> np.ndarray:
        """log10 of one over what the counts of a class add up to."""
        out = -np.log10(self.class_total + 0.5 * (self.class_distinct + 1))
        out[REPEAT] = 0.0
        return out

    def class_of(self, h: int, e: int) -> int:
        own = self.class_of_word.get(h)
        return int(self.class_of_ending[e]) if own is None else own

    def count(self, h: int) -> int:
        """The training count of a frequent word, -1 for any other."""
        i = int(np.searchsorted(self.hashes, h))
        return int(self.counts[i]) if i < len(self.hashes) and self.hashes[i] == h else -1

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Hash, class and count of words, as columns."""
        h = np.array([word_hash(w) for w in words], np.int64)
        classes = self.class_of_ending[np.array([ending(w) for w in words], np.int64)]
        for own, k in self.class_of_word.items():
            classes[h == own] = k
        counts = np.full(len(h), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            counts = np.where(self.hashes[at] == h, self.counts[at], -1)
        return np.stack([h, classes, counts])


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """Classes from ``counts`` (h, e, c): one row for each distinct training word."""
    # At most 65,537 endings, one row for each distinct count, and FREQUENT words.
    by_ending = counts.groupBy("e").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    least, room = 1, FREQUENT
    for r in sorted(counts.groupBy("c").count().collect(), key=lambda r: -r["c"]):
        if r["count"] > room:
            least = r["c"] + 1
            break
        room -= r["count"]
    frequent = counts.filter(F.col("c") >= least).toPandas()
    frequent = frequent.sort_values("h")
    top = frequent[frequent["h"] != END_HASH].sort_values(["c", "h"], ascending=[False, True]).head(WORD_CLASSES)
    total, distinct = sum(r["c"] for r in by_ending), sum(r["v"] for r in by_ending)
    words = {END_HASH: END, **{int(h): 2 + k for k, h in enumerate(top["h"])}}
    mass = {r["e"]: [r["c"], r["v"]] for r in by_ending if r["e"] >= 0}
    ends = next((r["c"] for r in by_ending if r["e"] < 0), 0)
    for e, c in zip(top["e"], top["c"]):
        mass[e][0] -= c
        mass[e][1] -= 1
    first = 2 + WORD_CLASSES
    endings = np.array([first + ENDING_CLASSES + e * 2654435761 % 2**32 * GROUPS // 2**32 for e in range(65536)], np.int64)
    for k, e in enumerate(sorted(mass, key=lambda e: (-mass[e][0], e))[:ENDING_CLASSES]):
        endings[e] = first + k
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    class_total[END], class_distinct[END] = ends, min(ends, 1)
    for k, c in enumerate(top["c"]):
        class_total[2 + k], class_distinct[2 + k] = c, 1
    for e, (c, v) in mass.items():
        class_total[endings[e]] += c
        class_distinct[endings[e]] += v
    h, c = frequent["h"].to_numpy(np.int64), frequent["c"].to_numpy(np.int64)
    classes = np.array([words.get(int(x), k) for x, k in zip(h, endings[frequent["e"].to_numpy(np.int64)])], np.int64)
    shares = (c + 0.5) / (class_total + 0.5 * (class_distinct + 1))[classes]
    short, at = np.unique(short_word(h, classes), return_inverse=True)
    return Vocabulary(total, distinct, words, endings, class_total, class_distinct, h, c, short, np.bincount(at, shares, len(short)))


def short_word(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class (6 bits) and hash (26 bits) of words."""
    return classes.astype(np.uint64) << np.uint64(26) | h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(38)


def word_features(h: np.ndarray, classes: np.ndarray, target: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Context (32 bits) and short word of every token as one number; 0 where the word has no feature."""
    own = classes >= FIRST
    context, found = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    for k, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        here = np.zeros(len(h), bool)
        here[k:] = own[:-k]
        here &= (place >= k) & ~found
        at = np.flatnonzero(here)
        x = h[at - k].view(np.uint64)
        context[at] = (x ^ x >> np.uint64(29)) * np.uint64(odd) >> np.uint64(32)
        found |= here
    return np.where(found & own & (target != REPEAT), context << np.uint64(32) | short_word(h, classes), np.uint64(0))


def slots(keys: np.ndarray) -> np.ndarray:
    """Numbers in the bitmap of contexts: leading bits of the context, and four of the class."""
    return (keys >> np.uint64(42) << np.uint64(4) | keys >> np.uint64(26) & np.uint64(15)).astype(np.int64)


class Words(dict):
    """Number of a word in this task, made as words turn up."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.rows = np.array([[END_HASH], [END], [self.vocabulary.count(END_HASH)]], np.int64)

    def __missing__(self, w: bytes) -> int:
        self.new.append(w)
        self[w] = n = len(self) + 1  # 0 is the end token
        return n

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, class, class or repeat, count and place of every token, and where texts begin."""
        if len(self) > TABLE:
            self.reset()
        numbers, sizes, find = [], [], self.__getitem__
        for t in texts:
            ws = tokens(t)
            numbers.extend(map(find, ws))
            numbers.append(0)
            sizes.append(len(ws) + 1)
        at = np.array(numbers, np.int64)
        if self.new:
            self.rows = np.concatenate([self.rows, self.vocabulary.rows(self.new)], axis=1)
            self.new = []
        h, classes, counts = (column[at] for column in self.rows)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        place = np.arange(len(at)) - np.repeat(begins, sizes)
        repeat = np.zeros(len(at), bool)
        repeat[1:] = (h[1:] == h[:-1]) & (place[1:] > 0)
        target = np.where(repeat, REPEAT, classes)
        return h, classes, target, counts, place, begins


def contexts(target: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The context of every token as one number: two classes before and the coarse third."""
    before = []
    for k in (1, 2, 3):
        b = np.zeros(len(target), np.int64)  # before a text there are end tokens
        b[k:] = target[:-k]
        b[place < k] = END
        before.append(b)
    return (before[0] * CLASSES + before[1]) * COARSE + before[2] * COARSE // CLASSES


def feature_rows(context: np.ndarray) -> np.ndarray:
    """Rows of the weights that each context switches on: bias, n-grams and skips, hashed."""
    one, two, three = context // (CLASSES * COARSE), context // COARSE % CLASSES, context % COARSE
    keys = [np.zeros_like(one), one + 1, (one * CLASSES + two), two, three, one * COARSE + three, context]
    out = np.empty((len(context), len(keys)), np.int64)
    for k, key in enumerate(keys):
        x = (key.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xC2B2AE3D27D4EB4F % 2**64)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = (x >> np.uint64(20)) % np.uint64(HASHED - CLASSES - 1) + np.uint64(CLASSES + 1)
    out[:, 0], out[:, 1] = 0, one + 1  # the bias and the class before are not shared
    return out


def log_softmax(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    logits = weights[feature_rows(context)].sum(axis=1)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _packed(part: np.ndarray, cuts: np.ndarray, columns: dict[str, np.ndarray], **same) -> Iterator[pa.RecordBatch]:
    """One row for each part: the bytes of its stretch, cuts[i] to cuts[i + 1], of every column."""
    for lo in range(0, len(part), 512):
        span = range(lo, min(lo + 512, len(part)))
        rows = {"part": pa.array(part[span.start : span.stop], pa.int32())}
        rows |= {name: pa.array([value] * len(span)) for name, value in same.items()}
        rows |= {name: pa.array([v[cuts[i] : cuts[i + 1]].tobytes() for i in span], pa.binary()) for name, v in columns.items()}
        yield pa.RecordBatch.from_pydict(rows)


def _cuts(part: np.ndarray) -> np.ndarray:
    """Where each stretch of equal parts begins, and the end."""
    return np.append(np.flatnonzero(np.diff(part, prepend=-(2**40))), len(part))


def _context_stage(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        words, total = Words(vocabulary), np.zeros(CONTEXTS * CLASSES, np.int32)
        shift, pending, size = np.uint64(64 - vocabulary.bits), [], 0

        def pairs() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(pending), return_counts=True)
            part = (keys >> shift).astype(np.int64)
            cuts = _cuts(part)
            yield from _packed(part[cuts[:-1]], cuts, {"keys": keys, "n": n.astype(np.uint32)})

        for _, texts in batches(it):
            h, classes, target, _, place, _ = words.batch(texts)
            cells, n = np.unique(contexts(target, place) * CLASSES + target, return_counts=True)
            total[cells] += n.astype(np.int32)
            keys = word_features(h, classes, target, place)
            pending.append(keys[keys > 0])
            size += len(pending[-1])
            if size > 2 * PACK:
                yield from pairs()
                pending, size = [], 0
        if size:
            yield from pairs()
        cells = np.flatnonzero(total)
        cuts = _cuts(cells // CHUNK)
        yield from _packed(-1 - cells[cuts[:-1]] // CHUNK, cuts, {"keys": cells.astype(np.uint64), "n": total[cells].astype(np.uint32)})

    return run


def _added(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    k, v = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[starts], np.add.reduceat(v, starts)


def _pair_stage(bits: int, least: int):
    """Counts of each part: cells of the class table, or the pairs that have a feature, their
    counts, those of their context and class, the part's bits of the bitmap, and counts of counts."""

    def result(part: int, keys: list, n: list) -> pa.RecordBatch:
        k, v = _added(keys, n)
        every, own, twice, thrice = np.zeros(0, np.int64), b"", 0, 0
        if part >= 0:
            q = k >> np.uint64(26)
            starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            every = np.repeat(np.add.reduceat(v, starts), np.diff(np.append(starts, len(q))))
            twice, thrice, keep = int((v == 2).sum()), int((v == 3).sum()), v >= least
            k, v, every = k[keep], v[keep], every[keep]
            known = np.zeros(2 ** (SLOT_BITS - bits), np.uint8)
            known[slots(k) - part * len(known)] = 1
            own = np.packbits(known).tobytes()
        values = {"part": pa.array([part], pa.int32()), "keys": [k.tobytes()], "n": [v.tobytes()], "every": [every.tobytes()], "slots": [own], "twice": [twice], "thrice": [thrice]}
        return pa.RecordBatch.from_pydict(values)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, n, size = None, [], [], 0
        for batch in it:
            for p, k, v in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "n"))):
                if p != part and keys:
                    yield result(part, keys, n)
                    keys, n, size = [], [], 0
                part = p
                keys.append(np.frombuffer(k, np.uint64))
                n.append(np.frombuffer(v, np.uint32).astype(np.int64))
                size += len(keys[-1])
                if size > 8 * PACK:
                    k, v = _added(keys, n)
                    keys, n, size = [k], [v], 0
        if keys:
            yield result(part, keys, n)

    return run


def _cell_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for k, v in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist()):
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.frombuffer(k, np.uint64).astype(np.int32)), "n": pa.array(np.frombuffer(v, np.int64))})


def _gradient_stage(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        cells, counts = [], []
        for batch in it:
            cells.append(batch.column("cell").to_numpy())
            counts.append(batch.column("n").to_numpy())
        if not cells:
            return
        cell, n = np.concatenate(cells).astype(np.int64), np.concatenate(counts).astype(np.float64)
        context, own = np.unique(cell // CLASSES, return_inverse=True)
        seen = np.zeros((len(context), CLASSES))
        seen[own, cell % CLASSES] = n
        logp = log_softmax(weights, context)
        gradient = np.zeros((HASHED, CLASSES))
        rest = seen - seen.sum(axis=1, keepdims=True) * np.exp(logp)
        rows = feature_rows(context)
        for k in range(rows.shape[1]):
            order = np.argsort(rows[:, k], kind="stable")
            r = rows[order, k]
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            gradient[r[starts]] += np.add.reduceat(rest[order], starts, axis=0)
        used = np.flatnonzero(np.abs(gradient).sum(axis=1))
        row = np.concatenate([[-1], used]).astype(np.int32)  # row -1 has the log-likelihood
        first = np.zeros((1, CLASSES))
        first[0, 0] = (seen * logp).sum()
        values = np.concatenate([first, gradient[used]]).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"row": pa.array(row), "v": pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * CLASSES, pa.int32()), pa.array(values.reshape(-1)))})

    return run


def _sum_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the vectors of the rows that one task has."""
    total: dict[int, np.ndarray] = {}
    for batch in it:
        for r, v in zip(batch.column("row").to_pylist(), batch.column("v").flatten().to_numpy().reshape(-1, CLASSES)):
            total[r] = total[r] + v if r in total else v.astype(np.float64)
    if total:
        values = np.concatenate(list(total.values()))
        yield pa.RecordBatch.from_pydict({"row": pa.array(list(total), pa.int32()), "v": pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * CLASSES, pa.int32()), pa.array(values.astype(np.float32)))})


def train(cells: DataFrame, parts: int = 6) -> np.ndarray:
    """Weights from ``cells`` (cell, n): context * CLASSES + class, and its count."""
    spark, kind = cells.sparkSession, "row int, v array<float>"
    weights = np.zeros((HASHED, CLASSES))
    # The start is the smoothed bigram model of classes, at most CLASSES squared counts.
    pairs = cells.groupBy(F.expr(f"cell div {CLASSES * CLASSES * COARSE}").alias("one"), F.expr(f"cell % {CLASSES}").alias("c")).agg(F.sum("n").alias("n")).collect()
    two = np.zeros((CLASSES, CLASSES))
    for r in pairs:
        two[r["one"], r["c"]] = r["n"]
    if not two.sum():
        return weights
    share = (two.sum(axis=0) + 0.5) / (two.sum() + 0.5 * CLASSES)
    weights[0] = np.log(share)
    weights[1 : CLASSES + 1] = np.log((two + 20 * share) / (two.sum(axis=1, keepdims=True) + 20)) - weights[0]
    cells = materialise(cells.repartition(parts, F.expr(f"cell div {CLASSES}")))
    n, best, first, second = two.sum(), (-np.inf, weights), 0.0, 0.0
    for step in range(1, ROUNDS + 2):
        shared = spark.sparkContext.broadcast(weights)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
        sums = cells.mapInArrow(_gradient_stage(shared), kind).repartition(parts, "row").mapInArrow(_sum_stage, kind)
        gradient, likelihood = np.zeros((HASHED, CLASSES)), 0.0
        for r in sums.collect():  # at most HASHED + 1 rows
            if r["row"] < 0:
                likelihood = r["v"][0]
            else:
                gradient[r["row"]] = r["v"]
        shared.destroy(blocking=True)  # else every round leaves a copy on the disk of each executor
        if likelihood > best[0]:
            best = (likelihood, weights)
        if step > ROUNDS:
            break
        gradient = gradient / n - 1e-7 * weights
        first, second = 0.8 * first + 0.2 * gradient, 0.95 * second + 0.05 * gradient**2
        scaled = first / (1 - 0.8**step) / (np.sqrt(second / (1 - 0.95**step)) + 1e-7)
        weights = weights + 0.15 / np.sqrt(step) * scaled
    bounded_batches(spark)
    return best[1].astype(np.float32)


def _score_stage(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, weights = shared.value
        words = Words(vocabulary)
        inside, ten = vocabulary.inside, np.float64(1 / np.log(10))
        table = np.concatenate([log_softmax(weights, np.arange(lo, min(lo + 4096, CONTEXTS))) for lo in range(0, CONTEXTS, 4096)])
        row = TaskContext.get().partitionId() << 33
        for batch, texts in batches(it):
            h, _, target, counts, place, begins = words.batch(texts)
            context = contexts(target, place)
            known, once = counts >= 0, target != REPEAT
            amount = np.where(known, np.log10(np.maximum(counts, 0) + 0.5), 0.0)
            model = table[context, target] * ten + inside[target] + np.where(once, amount, 0.0)
            sizes = np.diff(np.concatenate([begins, [len(h)]]))
            numbers = row + np.arange(len(texts), dtype=np.int64)
            row += len(texts)
            n = len(texts)
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(numbers), "rare": pa.array(np.zeros(n, bool)), "k": batch.column("doc_id").cast(pa.int64()), "held": batch.column("held"),
                "x": pa.array(np.add.reduceat(amount, begins)), "y": pa.array(np.add.reduceat(model, begins)),
                "a": pa.array(sizes.astype(np.int32)), "b": pa.array(np.add.reduceat((counts > 0).astype(np.int32), begins).astype(np.int32)),
            })
            rare = np.flatnonzero(~known)
            if len(rare):
                # One row for each rare word of a document, with its places and those that are no repeat.
                document = np.repeat(np.arange(n), sizes)[rare]
                order = np.lexsort((h[rare], document))
                d, w, o = document[order], h[rare][order], once[rare][order]
                starts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])]))
                m = len(starts)
                zero = pa.array(np.zeros(m))
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(numbers[d[starts]]), "rare": pa.array(np.ones(m, bool)), "k": pa.array(w[starts]), "held": pa.nulls(m, pa.bool_()), "x": zero, "y": zero,
                    "a": pa.array(np.diff(np.concatenate([starts, [len(d)]])).astype(np.int32)), "b": pa.array(np.add.reduceat(o.astype(np.int32), starts).astype(np.int32)),
                })

    return run


def _pack_stage(shared):
    """Tokens that may have a feature, packed by part: keys, documents (as distances from row
    ``home``) and hashes of the words that are not frequent (else 0)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, bitmap = shared.value
        words, bitmap = Words(vocabulary), np.frombuffer(bitmap, np.uint8)
        shift = np.uint64(64 - vocabulary.bits)
        row = home = TaskContext.get().partitionId() << 33
        pending, size = [], 0

        def packs() -> Iterator[pa.RecordBatch]:
            keys, of, h = (np.concatenate(x) for x in zip(*pending))
            part = (keys >> shift).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            cuts = _cuts(part)
            yield from _packed(part[cuts[:-1]], cuts, {"keys": keys[order], "a": of[order], "b": h[order]}, kind=1, home=home)

        for _, texts in batches(it):
            h, classes, target, counts, place, begins = words.batch(texts)
            keys = word_features(h, classes, target, place)
            slot = slots(keys)
            at = np.flatnonzero((keys > 0) & (bitmap[slot >> 3] >> (7 - (slot & 7)) & 1 > 0))
            of = np.searchsorted(begins, at, side="right") - 1 + row - home
            pending.append((keys[at], of.astype(np.uint32), np.where(counts[at] < 0, h[at], 0)))
            size += len(at)
            row += len(texts)
            if size > PACK:
                yield from packs()
                pending, size, home = [], 0, row
        if size:
            yield from packs()

    return run


class Features:
    """What the features of one part add to the log10 probability of a word in its class."""

    def __init__(self, vocabulary: Vocabulary, discount: float, keys: bytes, n: bytes, every: bytes):
        self.keys = k = np.frombuffer(keys, np.uint64)
        q, short = k >> np.uint64(26), k & np.uint64(2**32 - 1)
        p = (np.frombuffer(n, np.int64) - discount) / np.frombuffer(every, np.int64)
        if len(k):
            at = np.minimum(np.searchsorted(vocabulary.short, short), len(vocabulary.short) - 1)
            frequent = vocabulary.short[at] == short
            share = np.where(frequent, vocabulary.share[at], 0.0)
            starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            #: A word without a feature: one over the normaliser.
            self.contexts, self.other = q[starts], np.log10((1 - np.add.reduceat(p, starts)) / (1 - np.add.reduceat(share, starts)))
            #: A word with one: in place of its share; that of a rare word is taken off later, by its hash.
            self.rare = ~frequent
            self.own = np.log10(p) - np.where(frequent, np.log10(np.where(frequent, share, 1.0)), vocabulary.inside[(short >> np.uint64(26)).astype(np.int64)])

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each token gains, and whether its count is to be taken off."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit, q = self.keys[i] == keys, keys >> np.uint64(26)
        j = np.minimum(np.searchsorted(self.contexts, q), len(self.contexts) - 1)
        return np.where(hit, self.own[i], np.where(self.contexts[j] == q, self.other[j], 0.0)), hit & self.rare[i]


def _match_stage(shared, discount: float):
    """Packed tokens meet the features of their part; sums by document go back to ``home``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, part, features = shared.value, None, None
        for batch in it:
            names = ("part", "kind", "home", "keys", "a", "b")
            out: list[list] = [[], [], [], [], []]
            for p, kind, home, keys, a, b in zip(*(batch.column(c).to_pylist() for c in names)):
                if kind == 0:
                    part, features = p, Features(vocabulary, discount, keys, a, b)
                    continue
                if p != part:
                    continue  # no pair of this part has a feature
                of, h = np.frombuffer(a, np.uint32), np.frombuffer(b, np.int64)
                value, off = features.add(np.frombuffer(keys, np.uint64))
                off &= h != 0
                documents, at = np.unique(of, return_inverse=True)
                sums = np.bincount(at, value, len(documents))
                for column, x in zip(out, (home, documents.tobytes(), sums.tobytes(), of[off].tobytes(), h[off].tobytes())):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_pydict({"home": pa.array(out[0], pa.int64()), **{c: pa.array(v, pa.binary()) for c, v in zip(("of", "v", "rare_of", "rare"), out[1:])}})

    return run


def _gather_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document with its sum, and one for each rare word whose count is taken off."""

    def result(home: int, packs: list) -> Iterator[pa.RecordBatch]:
        of, v, rare_of, rare = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*packs), (np.uint32, np.float64, np.uint32, np.int64)))
        documents, at = np.unique(of, return_inverse=True)
        m = len(documents)
        rows, zero = pa.array(documents.astype(np.int64) + home), pa.array(np.zeros(m, np.int32))
        yield pa.RecordBatch.from_arrays([rows, pa.array(np.zeros(m, bool)), rows, pa.nulls(m, pa.bool_()), pa.array(np.zeros(m)), pa.array(np.bincount(at, v, m)), zero, zero], names=NAMES)
        if len(rare):
            order = np.lexsort((rare, rare_of))
            d, w = rare_of[order], rare[order]
            starts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])]))
            m, n = len(starts), np.diff(np.append(starts, len(d)))
            zero = pa.array(np.zeros(m))
            yield pa.RecordBatch.from_arrays([pa.array(d[starts].astype(np.int64) + home), pa.array(np.ones(m, bool)), pa.array(w[starts]), pa.nulls(m, pa.bool_()), zero, zero, pa.array(np.zeros(m, np.int32)), pa.array((-n).astype(np.int32))], names=NAMES)

    home, packs = None, []
    for batch in it:
        for row in zip(*(batch.column(c).to_pylist() for c in ("home", "of", "v", "rare_of", "rare"))):
            if row[0] != home and packs:
                yield from result(home, packs)
                packs = []
            home = row[0]
            packs.append(row[1:])
    if packs:
        yield from result(home, packs)


NAMES = ["row", "rare", "k", "held", "x", "y", "a", "b"]


def word_sums(docs: DataFrame, pairs: DataFrame, shared) -> DataFrame:
    """What word features add to the scores of ``docs``, in the columns of the scoring stage."""
    spark, vocabulary = docs.sparkSession, shared.value
    seen = pairs.agg(F.sum("twice").alias("two"), F.sum("thrice").alias("three")).first()
    # The discount is Good and Turing's for pairs seen twice.
    discount = float(np.clip(2 - 3 * (seen["three"] or 0) / max(seen["two"] or 0, 1), 0.5, 1.9))
    bitmap, size = np.zeros(2**SLOT_BITS // 8, np.uint8), 2 ** (SLOT_BITS - vocabulary.bits) // 8
    for r in pairs.select("part", "slots").collect():  # as many bytes as the bitmap has
        bitmap[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["slots"], np.uint8)
    packs = docs.mapInArrow(_pack_stage(spark.sparkContext.broadcast((vocabulary, bitmap.tobytes()))), "part int, kind long, home long, keys binary, a binary, b binary")
    tables = pairs.select("part", F.lit(0).cast("long").alias("kind"), F.lit(None).cast("long").alias("home"), "keys", F.col("n").alias("a"), F.col("every").alias("b"))
    # The documents come first in the union, so that a task's number is that of its partition of them.
    both = packs.unionByName(tables).repartition(2**vocabulary.bits, "part").sortWithinPartitions("part", "kind")
    sums = both.mapInArrow(_match_stage(shared, discount), "home long, of binary, v binary, rare_of binary, rare binary")
    return sums.repartition(2**vocabulary.bits, "home").sortWithinPartitions("home").mapInArrow(_gather_stage, KIND)


KIND = "row long, rare boolean, k long, held boolean, x double, y double, a int, b int"


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text", held_out(5, 1).alias("held"))
    training = docs.filter(~F.col("held")).select("doc_id", "text")
    counts = materialise(training.mapInArrow(_count_stage, "h long, e int, n long").groupBy("h", "e").agg(F.sum("n").alias("c")))
    vocabulary = build_vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocabulary)
    bits = vocabulary.bits
    packs = training.mapInArrow(_context_stage(shared), "part int, keys binary, n binary").repartition(2**bits, "part").sortWithinPartitions("part")
    tables = materialise(packs.mapInArrow(_pair_stage(bits, LEAST_PAIR), "part int, keys binary, n binary, every binary, slots binary, twice long, thrice long"))
    cells = tables.filter("part < 0").select("keys", "n").mapInArrow(_cell_stage, "cell int, n long")
    model = spark.sparkContext.broadcast((vocabulary, train(cells)))

    rows = docs.mapInArrow(_score_stage(model), KIND).unionByName(word_sums(docs, tables.filter("part >= 0"), shared))
    rows = rows.join(counts.select(F.col("h").alias("k"), "c"), "k", "left")
    rare, c = F.col("rare"), F.coalesce("c", F.lit(0))
    amount = F.log10(c + F.lit(0.5))
    sums = rows.groupBy("row").agg(
        F.max(F.when(~rare & (F.col("a") > 0), F.col("k"))).alias("doc_id"),
        F.max(F.when(~rare, F.col("held"))).alias("held_out"),
        F.sum(F.when(~rare, F.col("a"))).cast("long").alias("n_tokens"),
        F.sum(F.when(~rare, F.col("b")).when(c > 0, F.col("a")).otherwise(0)).cast("long").alias("n_known"),
        F.sum(F.when(rare, amount * F.col("a")).otherwise(F.col("x"))).alias("base"),
        F.sum(F.when(rare, amount * F.col("b")).otherwise(F.col("y"))).alias("score"),
    )
    whole = float(np.log10(vocabulary.total + 0.5 * (vocabulary.distinct + 1)))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(vocabulary.total)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score")
