"""Quality scores from a regularised quadratic discriminant over document statistics.

Each document gives ``FEATURES`` transformed statistics. Both classes of the
training labels get a mean and a covariance, from sums that Spark adds up (the
driver receives a fixed number of figures, whatever the corpus); each covariance
is shrunk towards a scaled identity by the oracle-approximating rule. A score is
the logistic of the scaled difference of the two Gaussian log-densities, whose
Mahalanobis terms use Cholesky factors computed once; scale and offset are fitted
on a histogram of that difference over all training labels.

Null text is an empty one, whose statistics are defined like any other's. If the
training labels lack a class or are empty, every score is the rate of label 1 (0.5
without labels). Documents without labels, repeated rows and null ids are scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import batches, bounded_batches, held_out, materialise

#: Fixed order of the statistics.
FEATURES = (
    "log words", "mean word length", "word length spread", "distinct words", "most frequent word", "repeated pairs",
    "repeated lines", "words a line", "upper case", "digits", "symbols", "bars", "sentence marks", "non-ASCII", "entropy", "short words",
)

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[*b"!#$%&*+/<=>@\\^_`~{}[]"]] = 3
_CLASS[124] = 4
_CLASS[[*b".,;:?"]] = 5
_CLASS[128:] = 6
_CLASS[97:123] = 7
_CLASS[[9, 10, 11, 12, 13, 32]] = 8


def _rate(x: float, n: float) -> float:
    """Log odds of a share, defined for all counts."""
    return float(np.log((x + 0.5) / (n - x + 0.5)))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text."""
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=9)
    total = max(1.0, float(counts.sum() - kinds[8]))
    share = counts[counts > 0] / max(1, counts.sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    tally = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split(b"\n") if x]
    return [
        float(np.log1p(n)),
        float(np.log1p(lengths.mean() if n else 0.0)),
        float(np.log1p(lengths.std() if n else 0.0)),
        float(np.log1p(len(tally)) / np.log1p(n)) if n else 1.0,
        _rate(max(tally.values(), default=0), max(n, 1)),
        _rate(max(0, n - 1 - pairs), max(n - 1, 1)),
        _rate(len(lines) - len(set(lines)), max(len(lines), 1)),
        float(np.log1p(n / max(1, len(lines)))),
        _rate(kinds[1], max(kinds[1] + kinds[7], 1.0)),
        _rate(kinds[2], total),
        _rate(kinds[3], total),
        _rate(kinds[4], total),
        _rate(kinds[5], total),
        _rate(kinds[6], total),
        float(-(share * np.log2(share)).sum()),
        _rate(int((lengths <= 3).sum()), max(n, 1)),
    ]


def _statistics_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in batches(it):
        rows = np.array([statistics(t) for t in texts], np.float64)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), pa.array(rows.reshape(-1)))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": values})


def document_statistics(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_statistics_stage, "doc_id long, x array<double>")


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy().reshape(len(values), -1)


def _moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in it:
        x, y = _matrix(batch), batch.column("y").to_numpy()
        for label in np.unique(y).tolist():
            own = x[y == label]
            s = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
            sums[label] = sums.get(label, 0) + s
    for label, s in sums.items():
        yield pa.RecordBatch.from_pydict({"y": pa.array(np.full(len(s), label, np.int32)), "k": pa.array(np.arange(len(s), dtype=np.int32)), "v": pa.array(s)})


@dataclass
class Discriminant:
    rate: float
    means: list[np.ndarray] | None = None
    factors: list[np.ndarray] | None = None  # inverse Cholesky factors
    offsets: list[float] | None = None
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, log priors included."""
        if self.means is None:
            return np.full(len(x), np.log(self.rate / (1 - self.rate)))
        d = [((x - m) @ f.T) for m, f in zip(self.means, self.factors)]
        return self.offsets[1] - self.offsets[0] - 0.5 * ((d[1] ** 2).sum(axis=1) - (d[0] ** 2).sum(axis=1))

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        if self.means is not None:
            m = self.scale * _squash(m) + self.shift
        return 1 / (1 + np.exp(-np.clip(m, -35, 35)))


def _squash(m: np.ndarray) -> np.ndarray:
    """Margins of far outliers compressed, order kept."""
    return np.sign(m) * np.log1p(np.abs(m))


def shrunk(cov: np.ndarray, n: int) -> np.ndarray:
    """Oracle-approximating shrinkage towards the mean variance on the diagonal."""
    d = len(cov)
    mu, power = np.trace(cov) / d, (cov**2).sum() / d**2
    top, bottom = power + mu**2, (n + 1) * (power - mu**2 / d)
    weight = 1.0 if bottom <= 0 else min(1.0, top / bottom)
    return (1 - weight) * cov + (weight * mu + 1e-6) * np.eye(d)


def logistic_1d(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through weighted 0/1 labels, lightly regularised."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        g = np.array([(weight * (y - p) * m).sum() - 1e-2 * (a - 1), (weight * (y - p)).sum() - 1e-3 * b])
        w = weight * p * (1 - p)
        h = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max() / 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on ``stats`` (doc_id, x) and ``labels`` (doc_id, y in 0/1, one row a document)."""
    rows = materialise(stats.join(labels, "doc_id").select("x", F.col("y").cast("int").alias("y")))
    d = len(FEATURES)
    sums = {y: np.zeros(1 + d + d * d) for y in (0, 1)}
    for r in rows.mapInArrow(_moments, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect():
        sums[r["y"]][r["k"]] = r["v"]
    n = [sums[y][0] for y in (0, 1)]
    model = Discriminant(float((n[1] + 0.5) / (n[0] + n[1] + 1)))
    if min(n) < 2:
        return model
    means = [sums[y][1 : 1 + d] / n[y] for y in (0, 1)]
    covs = [sums[y][1 + d :].reshape(d, d) / n[y] - np.outer(means[y], means[y]) for y in (0, 1)]
    spread = np.sqrt(np.maximum(np.diag((covs[0] * n[0] + covs[1] * n[1]) / sum(n)) + n[0] * n[1] / sum(n) ** 2 * (means[1] - means[0]) ** 2, 1e-9))
    factors, offsets = [], []
    for y in (0, 1):
        chol = np.linalg.cholesky(shrunk(covs[y] / np.outer(spread, spread), int(n[y])))
        factors.append(np.linalg.inv(chol) / spread)
        offsets.append(float(np.log(n[y] / sum(n)) - np.log(np.diag(chol)).sum()))
    model.means, model.factors, model.offsets = means, factors, offsets
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def margins(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            m = np.round(_squash(shared.value.margin(_matrix(batch))), 2)
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "m": pa.array(np.clip(m, -20, 20))})

    # At most 4001 places for each label.
    table = rows.mapInArrow(margins, "y int, m double").groupBy("y", "m").count().collect()
    m, y, w = (np.array([r[k] for r in table], float) for k in ("m", "y", "count"))
    model.scale, model.shift = logistic_1d(m, y, w)
    return model


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """One label of 0 or 1 for each document that may be learned from."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out(4, 2))
    return usable.groupBy("doc_id").agg(F.max(column).alias("y"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    stats = materialise(document_statistics(docs))
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, training_labels(labels, "quality")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(shared.value.score(_matrix(batch)))})

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
