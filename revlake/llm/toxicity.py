"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

*Voters.* A hand-written lexicon and patterns, and word stems that the training
labels single out. A stem voter fires where words that begin with the stem occur
at least so often. *Label model.* A two-class latent model over the votes of all
documents estimates how often each voter fires in either class, by
expectation-maximisation from the rates on training labels, or from fixed rates where
there are none. Correlations between voters within a class, estimated from the same
votes in every round, divide the weight of voters that say the same thing.
*Classifier.* A ridge logistic regression over the voters' counts is trained on the
posterior labels of all documents; its scale is set on the training labels, if there
are any.

Documents with equal counts are looked at once, with their number. The sums of a round
are one packed vector a task, added up by other tasks; the driver gets one vector.

Bounds. At most ``LABELLED`` labelled rows of each class (those of least hash)
are looked at to mine stems, to start the label model and to set the scale; votes,
correlations, posteriors and the classifier cover all documents. Stems come from whole
texts.

Null text is an empty one; it fires no voter and is scored like any text that fires
none. Very long texts are scored whole. Repeated rows and rows without an id count as
documents; the label of a repeated id is the greatest. An empty table gives no rows.
Extra columns do not matter; ``without_toxic`` returns them as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import ALNUM, add_up, batches, bounded_batches, held_out, materialise
from revlake.llm.quality import logistic_1d, training_labels

#: Labelled rows of each class that stems, weights and scale are learned from, at most.
LABELLED = 20_000
#: Pseudo-counts that hold the label model to the labelled rates, as a multiple of the
#: class's share of all documents; labels fewer than some SURE weigh less.
HOLD = 1.2
SURE = 100
#: Learned voters at most, and candidates that they are chosen from.
VOTERS, CANDIDATES = 60, 4000
STEM = (4, 5, 6, 7)
#: Least counts at which a stem voter fires; negative: so many in a thousand words.
OFTEN = (1, 2, 3, 5, 8, -4, -8, -15)
#: Rounds of expectation-maximisation; the classifier's penalty and steps at most.
ROUNDS, RIDGE, STEPS = 6, 1.0, 12
#: Distinct rows of counts that a task holds before it passes them on.
SHAPES = 20_000

#: Words of abuse, each one a voter; groups of patterns follow.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "scum", "loser", "losers", "trash", "stupid", "pathetic", "worthless", "disgusting", "clown", "vermin",
    "imbecile", "cretin", "filth", "bastard", "bitch", "whore", "slut", "retard", "asshole", "dumbass", "jackass", "crap", "shit", "bullshit",
    "fuck", "fucking", "fucker", "motherfucker", "cunt", "dickhead", "prick", "wanker", "twat", "faggot", "nigger", "parasite", "subhuman",
    "dummkopf", "idioten", "arschloch", "scheisse", "abschaum", "connard", "salope", "merde", "crétin", "débile", "ordure",
    "imbécil", "estúpido", "estúpida", "idiota", "mierda", "basura", "puta", "gilipollas", "escoria",
)
PATTERNS = {
    "insult to you": ("you are a ", "you are an ", "you re a ", "you fucking", "you stupid", "you idiot"),
    "wish of harm": ("kill yourself", "go die", "hope you die", "deserve to die", "drop dead"),
    "order to leave": ("shut up", "get lost", "screw you", "fuck off", "go to hell"),
}


def normal(text: bytes) -> str:
    """Words of a text in lower case between single or more spaces, one in front and behind."""
    return " " + text.translate(ALNUM).decode().lower() + " "


def stems(text: bytes) -> Counter:
    """How often words begin with each stem of STEM letters."""
    out: Counter = Counter()
    for w, n in Counter(normal(text).split()).items():
        for k in STEM:
            if len(w) >= k:
                out[w[:k]] += n
    return out


def _stem_stage(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()

        def flush():
            keys = list(tally)
            rows = {"stem": pa.array([k[0] for k in keys]), "often": pa.array([k[1] for k in keys], pa.int32()), "y": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array([tally[k] for k in keys], pa.int64())}
            tally.clear()
            return pa.RecordBatch.from_pydict(rows)

        for batch, texts in batches(it):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                y = shared.value[doc]
                of = len(text.split())
                for stem, n in stems(text).items():
                    for k in OFTEN:
                        if n >= k if k > 0 else 1000 * n >= -k * of:
                            tally[stem, k, y] += 1
            if len(tally) > 300_000:
                yield flush()
        if tally:
            yield flush()

    return run


@dataclass
class Voters:
    """Keys of one automaton; the voters are (group of keys, least count)."""

    groups: list[tuple[str, ...]] = field(default_factory=list)
    voters: list[tuple[int, int]] = field(default_factory=list)

    def add(self, keys: tuple[str, ...], often: int) -> None:
        if keys not in self.groups:
            self.groups.append(keys)
        self.voters.append((self.groups.index(keys), often))

    def automaton(self) -> ahocorasick.Automaton:
        owners: dict[str, list[int]] = {}
        for g, keys in enumerate(self.groups):
            for k in keys:
                owners.setdefault(k, []).append(g)
        a = ahocorasick.Automaton()
        for k, g in owners.items():
            a.add_word(k, tuple(g))
        a.make_automaton()
        return a


def hand_written() -> Voters:
    v = Voters()
    for w in LEXICON:
        v.add((f" {w} ",), 1)
    for keys in PATTERNS.values():
        v.add(tuple(f" {k.strip()} " for k in keys), 1)
    v.add(tuple(f" {w} " for w in LEXICON), 1)
    v.add(tuple(f" {w} " for w in LEXICON), 2)
    v.add(tuple(f" {w} " for w in LEXICON), 4)
    return v


class Tally:
    """Counts of every group of keys in a text, and the votes that follow from them."""

    def __init__(self, voters: Voters):
        self.automaton = voters.automaton()
        self.groups = len(voters.groups)
        self.group, self.often = (np.array(x) for x in zip(*voters.voters))

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text: a count for each group, and the words of texts that have any."""
        out = np.zeros((len(texts), self.groups + 1), np.int32)
        for row, text in zip(out, texts):
            found = False
            for _, owners in self.automaton.iter(normal(text)):
                found = True
                for g in owners:
                    row[g] += 1
            if found:
                row[-1] = len(text.split())
        return out

    def votes(self, counts: np.ndarray) -> np.ndarray:
        own = counts[:, self.group].astype(np.int64)
        return (own > 0) & np.where(self.often > 0, own >= self.often, 1000 * own >= -self.often * counts[:, -1:])


def features(counts: np.ndarray) -> np.ndarray:
    """Logarithms of each group's count and of its share in a thousand words, and a one."""
    rates = 1000 * counts[:, :-1] / np.maximum(counts[:, -1:], 1)
    return np.hstack([np.log1p(counts[:, :-1]), np.log1p(rates), np.ones((len(counts), 1))])


def _shape_stage(voters: Voters):
    """Distinct rows of counts with how many documents have them, added up in each task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, tally = Tally(voters), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"counts": pa.array(list(tally), pa.binary()), "n": pa.array(list(tally.values()), pa.int64())})
            tally.clear()
            return out

        for _, texts in batches(it):
            tally.update(r.astype("<i4").tobytes() for r in counter.counts(texts))
            if len(tally) > SHAPES:
                yield flush()
        if tally:
            yield flush()

    return run


def _matrix(column: pa.Array, groups: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, groups + 1)


def _choose(candidates: list, positives: int, negatives: int, voters: Voters) -> None:
    """Add learned stems, best first, without those that say what a chosen one says."""
    scored = []
    for r in candidates:
        a, b = (r["pos"] + 0.5) / (positives + 1), (r["neg"] + 0.5) / (negatives + 1)
        if a > 3 * b and r["pos"] >= max(4, 0.004 * positives):
            scored.append(((r["pos"] / positives) * np.log(a / b) ** 1.5, r["stem"], r["often"], r["pos"], r["neg"]))
    taken: list[tuple[str, int, int, int]] = []
    for _, stem, often, pos, neg in sorted(scored, key=lambda s: (-s[0], s[1], s[2])):
        if any(abs(p - pos) <= 0.03 * pos + 1 and abs(n - neg) <= 0.1 * neg + 2 and (s[:4] == stem[:4]) for s, o, p, n in taken):
            continue
        taken.append((stem, often, pos, neg))
        voters.add((f" {stem}",), often)
        if len(taken) >= VOTERS:
            break


@dataclass
class LabelModel:
    """Firing rates of each voter in the clean and the toxic class, weights, and the toxic share."""

    rates: np.ndarray  # 2 x voters
    weight: np.ndarray
    prior: float

    def posterior(self, v: np.ndarray) -> np.ndarray:
        c, t = self.rates
        fire, silent = self.weight * np.log(t / c), self.weight * np.log((1 - t) / (1 - c))
        logit = np.log(self.prior / (1 - self.prior)) + v @ (fire - silent) + silent.sum()
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def _sums(shapes: DataFrame, voters: Voters, model: LabelModel) -> np.ndarray | None:
    """Documents, toxic documents, how often each voter fires in either class, and each pair of voters (upper triangles)."""
    shared, n = shapes.sparkSession.sparkContext.broadcast(model), len(voters.voters)

    def total(it: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        counter, out, upper = Tally(voters), None, _upper(n)
        for batch in it:
            if batch.num_rows:
                v = counter.votes(_matrix(batch.column("counts"), counter.groups)).astype(np.float64)
                w = batch.column("n").to_numpy()
                p = shared.value.posterior(v)
                pairs = [((v * q[:, None]).T @ v)[upper] for q in (w * (1 - p), w * p)]
                mine = np.concatenate([[w.sum(), (w * p).sum()], (w * (1 - p)) @ v, (w * p) @ v, *pairs])
                out = mine if out is None else out + mine
        return out

    return add_up(shapes, total)


def next_model(s: np.ndarray, start: LabelModel, strength: np.ndarray) -> LabelModel:
    """The label model that the sums ``s`` of a round give, held to ``start`` by ``strength`` pseudo-counts of either class."""
    n = len(start.weight)
    mass = np.array([s[0] - s[1], s[1]])
    fired, pairs = s[2 : 2 + 2 * n].reshape(2, n), s[2 + 2 * n :].reshape(2, -1)
    rates = np.clip((fired + strength[:, None] * start.rates) / (mass + strength)[:, None], 1e-5, 1 - 1e-5)
    rates[1] = np.maximum(rates[1], rates[0] * 1.01)  # a voter never speaks for the clean class
    prior = float(np.clip((s[1] + strength.sum() * start.prior) / (s[0] + strength.sum()), 1e-4, 0.5))
    return LabelModel(np.clip(rates, 1e-5, 1 - 1e-5), weights_of(correlations(mass, fired, pairs)), prior)


def correlations(mass: np.ndarray, fired: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """How far each pair of voters fires together beyond chance within a class, the larger of both classes."""
    n = fired.shape[1]
    joint = np.zeros((2, n, n))
    joint[:, *_upper(n)] = pairs / np.maximum(mass, 1.0)[:, None]
    joint = np.maximum(joint, joint.transpose(0, 2, 1))
    alone = fired / np.maximum(mass, 1.0)[:, None]
    sd = np.sqrt(np.maximum(alone * (1 - alone), 1e-12))
    rho = np.clip((joint - alone[:, :, None] * alone[:, None, :]) / (sd[:, :, None] * sd[:, None, :]), 0, 1).max(axis=0)
    np.fill_diagonal(rho, 1.0)
    return rho


def weights_of(rho: np.ndarray) -> np.ndarray:
    """A voter's weight: one over the voters that say what it says, itself included."""
    return 1 / np.where(rho > 0.1, rho, 0).sum(axis=1)


def fit_label_model(shapes: DataFrame, voters: Voters, start: LabelModel, strength: np.ndarray) -> LabelModel:
    """Expectation-maximisation over all documents' votes (``shapes``: counts, n)."""
    model = start
    for _ in range(ROUNDS):
        s = _sums(shapes, voters, model)
        if s is None:
            return model
        model = next_model(s, start, strength)
    return model


def fit_classifier(shapes: DataFrame, voters: Voters, label_model: LabelModel) -> np.ndarray | None:
    """Weights of a ridge logistic regression on the posterior labels of all documents, by
    Newton steps whose sums Spark adds up; None without documents."""
    spark, d = shapes.sparkSession, 2 * len(voters.groups) + 1
    penalty = np.full(d, RIDGE)
    penalty[-1] = 1e-6
    b, upper = np.zeros(d), _upper(d)
    for _ in range(STEPS):
        shared = spark.sparkContext.broadcast((label_model, b))

        def total(it: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            counter, (model, at), g, h = Tally(voters), shared.value, 0.0, None  # noqa: B023
            for batch in it:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    counts = _matrix(part.column("counts"), counter.groups)
                    x, w = features(counts), part.column("n").to_numpy()
                    p = model.posterior(counter.votes(counts).astype(np.float64))
                    q = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
                    g = g + x.T @ (w * (p - q))
                    own = (x * (w * q * (1 - q))[:, None]).T @ x
                    h = own if h is None else h + own
            return None if h is None else np.concatenate([g, h[upper]])  # noqa: B023

        s = add_up(shapes, total)
        if s is None:
            return None
        h = np.zeros((d, d))
        h[upper] = s[d:]
        h = np.maximum(np.abs(h), np.abs(h.T)) * np.where(h == 0, np.sign(h.T), np.sign(h))
        step = np.linalg.solve(h + np.diag(penalty + 1e-9), s[:d] - penalty * b)
        step /= max(1.0, np.abs(step).max() / 3)
        b = b + step
        if np.abs(step).max() < 1e-4:
            break
    return b


@dataclass
class Model:
    """What scores a text: voters, label model, classifier, and the scale set on labels."""

    voters: Voters
    label_model: LabelModel
    weights: np.ndarray | None = None
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, counts: np.ndarray) -> np.ndarray:
        return np.clip(features(counts) @ self.weights, -20, 20)

    def scores(self, counter: Tally, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Score and the label model's posterior of every text."""
        counts = counter.counts(texts)
        posterior = self.label_model.posterior(counter.votes(counts).astype(np.float64))
        if self.weights is None:
            return posterior, posterior
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(counts) + self.shift, -35, 35))), posterior


def _labelled_counts(docs: DataFrame, ids: DataFrame, sample: dict[int, int], voters: Voters) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels of the sampled rows, one for each id."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Tally(voters)
        for batch, texts in batches(it):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "counts": pa.array([r.astype("<i4").tobytes() for r in counter.counts(texts)], pa.binary())})

    # At most 2 * LABELLED rows.
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, counts binary").groupBy("doc_id").agg(F.min("counts").alias("counts")).collect()
    groups = len(voters.groups)
    return np.array([np.frombuffer(r["counts"], "<i4") for r in rows]).reshape(-1, groups + 1), np.array([sample[r["doc_id"]] for r in rows], float)


def fit(docs: DataFrame, labels: DataFrame | None) -> Model:
    """Learn voters, label model and classifier from all texts of ``docs``, and from the labels that may be learned from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    voters, sample, share = hand_written(), {}, 0.05
    totals = {0: 0, 1: 0}
    if labels is not None:
        usable = training_labels(labels, "toxic")
        totals.update({r["y"]: r["count"] for r in usable.groupBy("y").count().collect()})
        for y in (0, 1):
            for r in usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).collect():
                sample[r["doc_id"]] = y
    ids = spark.createDataFrame([(i,) for i in sample], "doc_id long")  # at most 2 * LABELLED rows
    if sample:
        share = float(np.clip(totals[1] / max(1, sum(totals.values())), 1e-3, 0.5))
        shared = spark.sparkContext.broadcast(sample)
        seen = docs.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_stem_stage(shared), "stem string, often int, y int, n long")
        tally = seen.groupBy("stem", "often").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))
        positives, negatives = (sum(1 for v in sample.values() if v == y) for y in (1, 0))
        ratio = (F.col("pos") + 0.5) / (F.col("neg") + 0.5) * ((negatives + 1) / (positives + 1))
        best = tally.filter((F.col("pos") >= max(4, 0.004 * positives)) & (ratio > 3)).orderBy(F.desc(F.col("pos") * F.log(ratio)), "stem", "often").limit(CANDIDATES).collect()
        if positives and negatives:
            _choose(best, positives, negatives, voters)
    n, counter = len(voters.voters), Tally(voters)
    shapes = docs.mapInArrow(_shape_stage(voters), "counts binary, n long").groupBy("counts").agg(F.sum("n").alias("n"))
    shapes = materialise(shapes)

    counts, y = _labelled_counts(docs, ids, sample, voters) if sample else (np.zeros((0, len(voters.groups) + 1), np.int32), np.zeros(0))
    v = counter.votes(counts).astype(np.float64)
    rates = np.empty((2, n))
    for k in (0, 1):
        own = v[y == k]
        hand = 0.002 if k == 0 else 0.05
        rates[k] = (own.sum(axis=0) + hand) / (len(own) + 1.0)
    rates = np.clip(rates, 1e-5, 1 - 1e-5)
    rates[1] = np.maximum(rates[1], rates[0] * 1.01)
    documents = shapes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    labelled, parts = np.array([(y == k).sum() for k in (0, 1)]), np.array([1 - share, share])
    strength = 50.0 + HOLD * documents * parts * labelled / (labelled + SURE)
    label_model = fit_label_model(shapes, voters, LabelModel(rates, np.ones(n), share), strength)
    model = Model(voters, label_model, fit_classifier(shapes, voters, label_model))
    if model.weights is not None and 0 < y.sum() < len(y):
        # The sample holds the classes in other shares than the labels do.
        w = np.where(y == 1, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
        model.scale, model.shift = logistic_1d(model.margin(counts), y, w / w.mean())
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1: toxic) and the label model's posterior for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Tally(shared.value.voters)
        for batch, texts in batches(it):
            score, posterior = shared.value.scores(counter, texts)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score), "posterior": pa.array(posterior)})

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, posterior double")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "posterior")


def without_toxic(docs: DataFrame, labels: DataFrame | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Tally(shared.value.voters)
        for batch, texts in batches(it):
            yield batch.filter(pa.array(shared.value.scores(counter, texts)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
