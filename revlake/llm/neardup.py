"""Near-duplicate documents by a chosen-path set similarity join.

*Sets.* A document's set is its distinct ``WIDTH``-word shingles, as 64-bit hashes
of the words between single spaces; a shorter document has one shingle, one without
words has none and is linked with nothing. Documents with equal sets form a class,
which is looked at once. *Sketch.* ``COORDINATES`` minwise hashes of the set.

*Trees.* In each of ``TREES`` independent trees a class goes from a node to the
children named by those of its minwise tokens (coordinate, value) that a hash of
tree, path and token picks, ``BRANCHES`` of them on average; classes that share a
picked token meet in the child. Nodes of one class end. In every node all classes
are compared with one central class; candidates whose sketches and sizes allow the
similarity are confirmed on the full sets. What is confirmed is contracted: a node
all of whose classes are connected needs no more comparisons, so groups of copies of
any size cost a star of links, not all pairs. Other nodes with at most ``CROSS`` pairs
between components are compared exhaustively across them; larger ones branch again.
Nodes that are still large after ``DEPTH`` levels are compared exhaustively block
against block, so nothing is dropped. What sketches allow is kept as clusters of
classes, not as pairs; in each cluster all pairs between components are confirmed on
full sets, which go there once.

*Recall.* Two sets of similarity 0.75 share a picked token of one tree and level
with probability 0.78, so one level misses a pair with 3e-7; a pair that must
survive three levels is missed with 3e-5. A sketch rejects a true pair with 3e-5.

*Components* are the least labels over confirmed links: in one task where a count
shows that the links are few, else by label propagation with pointer jumping on
tables in the shared folder. Nothing is collected to the driver but counts. Null text: no words. Documents without an id link like any other, never
give a component its id, and are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.llm.common import BROADCAST_ROWS, LOWER, batches, bounded_batches, materialise, sized

WIDTH = 5
THRESHOLD = 75
COORDINATES = 64
#: Equal coordinates of two sketches at least, for the full sets to be compared.
LEAST_EQUAL = 33
TREES = 10
BRANCHES = 2.0
#: Pairs between components that one node may compare exhaustively (about a second's work),
#: and classes of a block of a node that is larger still.
CROSS = 100_000_000
SMALL = 4_000
DEPTH = 5
#: Nodes up to this size are compared many at once.
FEW = 32
#: Members of all sets of a block whose sets are compared; two blocks are held at once.
MEMBERS = 500_000
#: Nodes above this size are compared with a central class, found from a sample of so many.
CENTRAL, SAMPLE = 8, 64

_rng = np.random.default_rng(20_011)
_LETTER = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_MULTIPLIERS = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MOST = 1 << 20
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_STEP, _BACK):
            _powers.append(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_MOST, base)]), dtype=np.uint64))
    return _powers


def _window_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive words, from prefix sums over the joined bytes."""
    step, back = _power_tables()
    data = np.frombuffer(b" ".join(words), np.uint8)
    if len(data) > _MOST:  # words longer than the tables: one by one
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)], np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * step[: len(data)], dtype=np.uint64)])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    ends = ends[k - 1 :]
    return _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(WIDTH, len(words))
    if len(text) <= _MOST // 2:
        return np.unique(_window_hashes(words, k))
    parts, lo = [], 0
    while lo <= len(words) - k:  # pieces of a very long text, overlapping by k - 1 words
        hi, size = lo, 0
        while hi < len(words) and (hi - lo < k or size + len(words[hi]) < _MOST // 2):
            size += len(words[hi]) + 1
            hi += 1
        parts.append(np.unique(_window_hashes(words[lo:hi], k)))
        lo = hi - k + 1
    return np.unique(np.concatenate(parts))


def sketch(values: np.ndarray) -> np.ndarray:
    """The minwise hash of each coordinate, as 32-bit integers."""
    best = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for lo in range(0, len(values), 4096):
        np.minimum(best, (values[lo : lo + 4096, None] * _MULTIPLIERS).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def class_of(values: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(xxhash.xxh3_128_digest(values.tobytes())[:8], "little", signed=True)


def _sketch_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in batches(it):
        sets = [shingles(t) for t in texts]
        yield pa.RecordBatch.from_pydict({
            **{c: batch.column(c) for c in batch.schema.names if c != "text"},
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "cid": pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
            "sketch": pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
        })


def _sets_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in batches(it):
        for cid, text in zip(batch.column("cid").to_pylist(), texts):
            members = shingles(text)
            if class_of(members) == cid:
                yield pa.RecordBatch.from_pydict({"cid": pa.array([cid], pa.int64()), "members": pa.array([members.tobytes()], pa.binary())})


def _branch(paths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and names of the children that the rows' minwise tokens pick."""
    limit = np.uint64(int(2**32 * BRANCHES / COORDINATES))
    named = _mix(tokens ^ (paths * np.uint64(0xA24BAED4963EE407))[:, None])
    row, at = np.nonzero((named & np.uint64(0xFFFFFFFF)) < limit)
    return row, _mix(named[row, at] + np.uint64(1)).view(np.int64)


def _tokens(sketches: pa.Array) -> np.ndarray:
    places = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _mix(np.frombuffer(b"".join(sketches.to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint64) ^ places)


def _root_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of every row (cid, sketch) in all trees."""
    for batch in it:
        if batch.num_rows:
            tokens = _tokens(batch.column("sketch"))
            for tree in range(1, TREES + 1):
                row, path = _branch(np.full(len(tokens), tree, np.uint64), tokens)
                yield pa.RecordBatch.from_pydict({"path": pa.array(path), "cid": batch.column("cid").take(pa.array(row))})


def _branch_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of every row (path, cid, sketch)."""
    for batch in it:
        if batch.num_rows:
            row, path = _branch(batch.column("path").to_numpy().view(np.uint64), _tokens(batch.column("sketch")))
            yield pa.RecordBatch.from_pydict({"path": pa.array(path), "cid": batch.column("cid").take(pa.array(row))})


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _signature_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of every minwise hash, by which sketches are compared."""
    for batch in it:
        low = [np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in batch.column("sketch").to_pylist()]
        yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in batch.schema.names}, "sig": pa.array(low, pa.binary())})


def _similar(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sketches and sizes allow the similarity."""
    return ((a == b).sum(axis=-1) >= LEAST_EQUAL) & (100 * np.minimum(na, nb) >= THRESHOLD * np.maximum(na, nb))


def _close(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of rows, sorted by component, that sketches and sizes allow: of different
    components, and of different sides unless the side is -1. Coordinate by coordinate, for
    some rows against some others at a time."""
    columns = np.ascontiguousarray(sig.T)
    for lo in range(0, len(n), 256):
        own = slice(lo, lo + 256)
        for at in range(lo, len(n), 4096):
            rest = slice(at, at + 4096)
            if comp[lo] == comp[rest][-1]:  # sorted, so all are of one component
                continue
            equal = np.zeros((len(n[own]), len(n[rest])), np.uint8)
            for column in columns:
                equal += column[own][:, None] == column[rest]
            i, j = np.nonzero(equal >= LEAST_EQUAL)
            i, j = i + lo, j + at
            use = (i < j) & (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] < 0))
            i, j = i[use], j[use]
            use = 100 * np.minimum(n[i], n[j]) >= THRESHOLD * np.maximum(n[i], n[j])
            yield i[use], j[use]


def _allow_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if batch.num_rows:
            ok = _similar(_signatures(batch.column("sig_a")), _signatures(batch.column("sig_b")), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(ok))


def _confirm_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        ok = []
        for x, y in zip(batch.column("members_a"), batch.column("members_b")):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(a) + len(b) - len(np.union1d(a, b))
            ok.append(100 * both >= THRESHOLD * (len(a) + len(b) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _exhaust_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that sketches allow to be linked, between components in every small node or
    across two blocks of a large one (side: the block of a row, -1 where pairs within
    count), each with the least one that such pairs lead to: a row for each class at
    most, not for each pair. Rows come sorted by node."""
    names = ("path", "x", "y", "cid", "comp", "n", "side")

    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            edges.append((a, b))
            if sum(len(x) for x, _ in edges) > 500_000:
                edges[:] = [spanning()]

    def spanning() -> tuple[np.ndarray, np.ndarray]:
        """What the pairs so far connect, as one pair for each class but the least."""
        ends, least = least_labels(*(np.concatenate(x) for x in zip(*edges)))
        far = ends != least
        return least[far], ends[far]

    def pairs(c: dict[str, np.ndarray], sig: np.ndarray) -> None:
        new = np.ones(len(c["path"]), bool)
        new[1:] = (c["path"][1:] != c["path"][:-1]) | (c["x"][1:] != c["x"][:-1]) | (c["y"][1:] != c["y"][:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([starts, [len(new)]]))
        for lo, m in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            rows = lo + np.argsort(c["comp"][lo : lo + m], kind="stable")
            for i, j in _close(sig[rows], c["n"][rows], c["comp"][rows], c["side"][rows]):
                keep(c["cid"][rows[i]], c["cid"][rows[j]])
        for m in np.unique(sizes[(sizes > 1) & (sizes <= FEW)]).tolist():
            left, right = np.triu_indices(m, 1)
            own = starts[sizes == m]
            step = max(1, 50_000 // len(left))
            for lo in range(0, len(own), step):
                i = (own[lo : lo + step, None] + left).reshape(-1)
                j = (own[lo : lo + step, None] + right).reshape(-1)
                use = (c["comp"][i] != c["comp"][j]) & ((c["side"][i] != c["side"][j]) | (c["side"][i] < 0))
                i, j = i[use], j[use]
                ok = _similar(sig[i], sig[j], c["n"][i], c["n"][j])
                keep(c["cid"][i[ok]], c["cid"][j[ok]])

    held, kept = None, None
    for batch in it:
        if not batch.num_rows:
            continue
        c = {k: batch.column(k).to_numpy() for k in names}
        sig = _signatures(batch.column("sig"))
        if held is not None:
            c, sig = {k: np.concatenate([held[k], c[k]]) for k in names}, np.concatenate([kept, sig])
        # The last node may go on in the next batch.
        last = (c["path"] == c["path"][-1]) & (c["x"] == c["x"][-1]) & (c["y"] == c["y"][-1])
        cut = int(np.flatnonzero(last)[0]) if last.any() else len(last)
        pairs({k: v[:cut] for k, v in c.items()}, sig[:cut])
        held, kept = {k: v[cut:] for k, v in c.items()}, sig[cut:]
    if held is not None:
        pairs(held, kept)
    if edges:
        a, b = spanning()
        yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


def _verify_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components, on full sets, in every cluster or across two of its blocks.
    Of each set in turn the members are marked and those of its candidates counted; what is
    linked by then, if only by way of others, is not compared again."""
    names = ("cluster", "x", "y", "cid", "comp", "side", "n")

    def links(c: dict[str, np.ndarray], sets: list[np.ndarray], sig: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(sets) < 2:
            return
        order = np.argsort(c["comp"], kind="stable")
        c, sets = {k: v[order] for k, v in c.items()}, [sets[k] for k in order.tolist()]
        signs = np.frombuffer(b"".join(sig), np.uint8).reshape(-1, COORDINATES)[order]
        every, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        members = np.split(numbers, ends[:-1])
        mark = np.zeros(len(every), np.uint8)
        label = np.unique(c["comp"], return_inverse=True)[1]
        found_a, found_b = [], []
        for i, j in _close(signs, c["n"], c["comp"], c["side"]):
            by = np.argsort(i, kind="stable")
            i, j = i[by], j[by]
            cuts = np.flatnonzero(np.diff(i)) + 1
            for one, others in zip(np.split(i, cuts), np.split(j, cuts)):
                if not len(one):
                    continue
                k = int(one[0])
                mark[members[k]] = 1
                while True:
                    others = others[label[others] != label[k]]
                    if not len(others):
                        break
                    some, others = others[:64], others[64:]
                    starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    both = np.add.reduceat(mark[np.concatenate([members[o] for o in some.tolist()])], starts, dtype=np.int64)
                    for o in some[100 * both >= THRESHOLD * (sizes[some] + sizes[k] - both)].tolist():
                        found_a.append(int(c["cid"][k]))
                        found_b.append(int(c["cid"][o]))
                        label[label == label[o]] = label[k]
                mark[members[k]] = 0
        if found_a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(found_a, found_b)), "b": pa.array(np.maximum(found_a, found_b))})

    def empty() -> tuple[dict[str, np.ndarray], list[np.ndarray], list[bytes]]:
        return {k: np.zeros(0, np.int64) for k in names}, [], []

    held, kept, signs = empty()
    for batch in it:
        c = {k: batch.column(k).to_numpy().astype(np.int64) for k in names}
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("members").to_pylist()]
        sig = batch.column("sig").to_pylist()
        cuts = [0, *(np.flatnonzero((np.diff(c["cluster"]) != 0) | (np.diff(c["x"]) != 0) | (np.diff(c["y"]) != 0)) + 1).tolist(), len(sets)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if len(kept) and any(held[k][0] != c[k][lo] for k in names[:3]):
                yield from links(held, kept, signs)
                held, kept, signs = empty()
            held = {k: np.concatenate([held[k], c[k][lo:hi]]) for k in names}
            kept, signs = kept + sets[lo:hi], signs + sig[lo:hi]
    yield from links(held, kept, signs)


def _mode_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent byte of each coordinate over the sampled classes of a node."""
    for batch in it:
        modes = []
        for sample in batch.column("sample").to_pylist():
            x = np.frombuffer(b"".join(sample), np.uint8).reshape(-1, COORDINATES).astype(np.int64)
            counts = np.bincount((x + 256 * np.arange(COORDINATES)).reshape(-1), minlength=256 * COORDINATES)
            modes.append(counts.reshape(COORDINATES, 256).argmax(axis=1).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "mode": pa.array(modes, pa.binary())})


def _match_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if batch.num_rows:
            same = (_signatures(batch.column("sig")) == _signatures(batch.column("mode"))).sum(axis=1)
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "cid": batch.column("cid"), "same": pa.array(same.astype(np.int32))})


def _stars(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs (a, b) of every class of a node with the node's pivot: the least class of a
    small node; in others the class nearest to the coordinates' most frequent values, as
    edited copies of one text meet in that text, not in each other. The choice has no
    part in what is found in the end, only in how many comparisons it takes."""
    sig = seen.select("cid", "sig")
    some = rows.filter(F.col("size") > CENTRAL).select("path", "cid")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.xxhash64("cid")))
    sampled = some.withColumn("r", rank).filter(F.col("r") <= SAMPLE).join(sig, "cid")
    modes = sampled.groupBy("path").agg(F.collect_list("sig").alias("sample")).mapInArrow(_mode_stage, "path long, mode binary")
    matched = some.join(modes, "path").join(sig, "cid").select("path", "cid", "sig", "mode").mapInArrow(_match_stage, "path long, cid long, same int")
    central = matched.groupBy("path").agg(F.max_by("cid", F.struct("same", "cid")).alias("central"))
    star = rows.join(central, "path", "left").select("cid", F.coalesce("central", "pivot").alias("pivot")).filter("cid <> pivot")
    return star.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b"))


def _nodes(rows: DataFrame) -> DataFrame:
    """Rows (path, cid) of nodes with two classes or more, with size and least class."""
    nodes = rows.groupBy("path").agg(F.count("*").alias("size"), F.min("cid").alias("pivot")).filter("size > 1")
    return rows.join(nodes, "path")


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of links in order, and for each the least end that can be reached."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ends))
    while True:
        near = label.copy()
        np.minimum.at(near, x, label[y])
        np.minimum.at(near, y, label[x])
        np.minimum.at(near, label, near.copy())  # what one end finds holds for its label
        near = near[near]
        if (near == label).all():
            return ends, ends[label]
        label = near


def _components_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in it]
    if rows:
        cid, comp = least_labels(*(np.concatenate(c) for c in zip(*rows)))
        yield pa.RecordBatch.from_pydict({"cid": pa.array(cid), "comp": pa.array(comp)})


def components(links: DataFrame) -> DataFrame:
    """(cid, comp) for the ends of ``links`` (a, b): the least name that can be reached.
    Up to a checked count of links one task does it, beyond that label propagation."""
    if links.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return materialise(links.select("a", "b").coalesce(1).mapInArrow(_components_stage, "cid long, comp long"))
    return propagated(links)


def propagated(links: DataFrame) -> DataFrame:
    """``components`` by tables: least neighbour, then the label of the label."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both)
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "cid"))
    while True:
        near = both.join(labels.select(F.col("cid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "cid").select("cid", "comp", F.least("comp", "near").alias("next"))
        over = labels.select(F.col("cid").alias("next"), F.col("comp").alias("over"))
        new = materialise(step.join(over, "next").select("cid", "comp", F.least("next", "over").alias("new")))
        changed = new.filter("new <> comp").limit(1).count()
        labels = new.select("cid", F.col("new").alias("comp"))
        if not changed:
            return labels


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and text, and a hash of the text, which tells rows apart that have no id or share one."""
    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and group: a name of the component that ids
    have no part in, null without words; hash: of the text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = _rows(docs)
    base = materialise(docs.mapInArrow(_sketch_stage, "doc_id long, hash long, n long, cid long, sketch binary"))
    small = base.select("doc_id", "hash", "n", "cid")
    # A class stands for itself by the text of its least id, or of any row where ids are missing.
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("rep"), "hash")).alias("first")
    classes = base.filter("cid is not null").groupBy("cid").agg(first, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialise(classes.select("cid", "first.rep", "first.hash", "n", "sketch"))

    rows = materialise(_nodes(classes.select("cid", "sketch").mapInArrow(_root_stage, "path long, cid long")))
    met = classes.join(rows.select("cid").distinct(), "cid", "left_semi")
    seen = materialise(met.mapInArrow(_signature_stage, "cid long, rep long, hash long, n long, sketch binary, sig binary"))

    def full_sets(ends: DataFrame) -> DataFrame:
        """(cid, members) of the classes named in ``ends``, from their texts."""
        ids = materialise(seen.select("cid", "rep", F.col("hash").alias("of")).join(ends, "cid"))
        own = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("hash") == F.col("of"))
        sets = docs.join(sized(ids), own).select("cid", "text").mapInArrow(_sets_stage, "cid long, members binary")
        return materialise(sets.groupBy("cid").agg(F.first("members").alias("members")))  # rows may repeat

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are links, confirmed on the full sets."""
        pairs = pairs.select("a", "b").distinct()
        of = lambda s: seen.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
        allowed = materialise(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(_allow_stage, "a long, b long"))
        sets = full_sets(allowed.select(F.col("a").alias("cid")).union(allowed.select("b")).distinct())
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
        full = lambda s: sets.select(F.col("cid").alias(s), F.col("members").alias(f"members_{s}"))
        out = materialise(allowed.join(full("a"), "a").join(full("b"), "b").select("a", "b", "members_a", "members_b").mapInArrow(_confirm_stage, "a long, b long"))
        bounded_batches(spark)
        return out

    def verified(spanning: DataFrame) -> DataFrame:
        """Links between components in the clusters that ``spanning`` (a, b) connects.
        Every set goes once to its cluster, or to each pair of blocks of a large one."""
        clusters = components(spanning.distinct()).withColumnRenamed("comp", "cluster")
        sets = full_sets(clusters.select("cid"))
        clusters = clusters.join(seen.select("cid", "n", "sig"), "cid")
        sizes = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(MEMBERS)).cast("int").alias("blocks"))
        rows = clusters.join(sizes, "cluster").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("cluster", "cid", "comp", "n", "sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"))
        # A block against itself has one row for each class, and so pairs within (side -1).
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
        dealt = rows.join(sets, "cid").select("cluster", "x", "y", "cid", "comp", "side", "n", "sig", "members").repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
        out = materialise(dealt.mapInArrow(_verify_stage, "a long, b long"))
        bounded_batches(spark)
        return out

    links, waiting, comps = None, [], None
    for depth in range(DEPTH):
        star = _stars(rows, seen)
        if comps is not None:  # what is connected already needs no comparison
            of = lambda s: comps.select(F.col("cid").alias(s), F.col("comp").alias(f"comp_{s}"))
            star = star.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b"))
        new = confirmed(star)
        if links is None or new.limit(1).count():
            links = new if links is None else links.union(new)
            comps = components(links)
        labelled = rows.join(comps, "cid", "left").select("path", "cid", F.coalesce("comp", "cid").alias("comp"))
        parts = labelled.groupBy("path", "comp").agg(F.count("*").cast("double").alias("n")).groupBy("path")
        mixed = parts.agg(F.count("*").alias("k"), F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("q")).filter("k > 1")
        mixed = mixed.select("path", ((F.col("m") * F.col("m") - F.col("q")) / 2).alias("across"))
        active = materialise(rows.select("path", "cid", "size").join(mixed, "path"))
        waiting.append(active.filter(F.col("across") <= CROSS).select("path", "cid"))
        large = active.filter(F.col("across") > CROSS)
        if depth == DEPTH - 1 or not large.limit(1).count():
            break
        branched = large.select("path", "cid").join(seen.select("cid", "sketch"), "cid").select("path", "cid", "sketch")
        rows = materialise(_nodes(branched.mapInArrow(_branch_stage, "path long, cid long")))

    rest = waiting[0]
    for w in waiting[1:]:
        rest = rest.union(w)
    info = seen.join(comps, "cid", "left").select("cid", "n", "sig", F.coalesce("comp", "cid").alias("comp"))
    groups = rest.select("path", "cid", F.lit(-1).alias("side"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    blocks = F.ceil(F.col("size") / F.lit(SMALL)).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    cut = large.select("path", "cid", blocks.alias("blocks"), own.alias("own")).select("path", "cid", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    groups = groups.union(cut.select("path", "cid", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))
    # Within a block all pairs count (side -1), between two blocks only those across.
    # What a group compares is bounded by CROSS or by its blocks.
    dealt = groups.join(info, "cid").repartition("path", "x", "y").sortWithinPartitions("path", "x", "y")
    pairs = dealt.mapInArrow(_exhaust_stage, "a long, b long")
    last = verified(materialise(pairs))
    comps = components(links.union(last))

    least = comps.join(classes.select("cid", "rep"), "cid").groupBy("comp").agg(F.min("rep").alias("component"))
    linked = materialise(comps.join(least, "comp").select("cid", "comp", "component"))
    named = classes.select("cid", "rep").join(linked, "cid", "left").select("cid", F.coalesce("component", "rep").alias("component"), F.coalesce("comp", "cid").alias("group"))
    found = small.join(named, "cid", "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "group", "hash")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, for each component: that of the least id, or the least
    hash of a text where ids are missing; of rows that repeat id and text, one. Rows without
    words stay."""
    found = materialise(near_duplicates(docs).filter("group is not null").groupBy("group", "doc_id", "hash").agg(F.count("*").alias("copies")))
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("hash").alias("of"))).alias("first"))
    kept = first.select("group", "first.id", "first.of")
    chosen = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of"))
    # Rows that leave the main path: those not chosen, and chosen ones that stand there more than once.
    out = materialise(found.join(kept, "group").select("doc_id", "hash", "copies", chosen.alias("chosen")).filter("not chosen or copies > 1"))
    whole = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"), F.struct(*docs.columns).alias("doc"))
    same = F.col("key.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("key.hash") == F.col("hash"))
    rest = whole.join(sized(out.select("doc_id", "hash")), same, "left_anti").select("doc")
    repeated = out.filter("chosen")
    if repeated.limit(1).count():
        rest = rest.union(whole.join(sized(repeated.select("doc_id", "hash")), same, "left_semi").groupBy("key").agg(F.first("doc").alias("doc")).select("doc"))
    return rest.select("doc.*")
