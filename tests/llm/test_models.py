"""Trained operators: learnable fixtures, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_rows import texts

from revlake.llm import maxent, quality, toxicity

DOC = "doc_id long, text string"


def held(i, m, r):
    return i is not None and zlib.crc32(str(i).encode()) % m == r


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    syllables = ["the", "ing", "tion", "er", "and", "re", "on", "st", "ha", "ou"]
    rows, labels = [], []
    for i in range(500):
        ws = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(30, 200))]
        bad, toxic = i % 4 == 0, i % 5 == 1
        if bad:
            ws = [w + "###" for w in ws] if i % 8 else [w.upper() + "!!" for w in ws]
        if toxic:
            for k in range(0, len(ws), 12):
                ws[k] = "grumf" + ws[k] if i % 2 else "idiot"
        rows.append((i, " ".join(ws)))
        labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(out, labels, k):
    truth = {x[0]: x[k] for x in labels}
    mine = [r for r in out if r.held_out]
    assert len(mine) > 50 and all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in out)
    return np.mean([r.predicted == truth[r.doc_id] for r in mine])


def test_quality_held_out(corpus):
    docs, labels, truth = corpus
    assert accuracy(quality.score_quality(docs, labels).collect(), truth, 1) > 0.95


def test_toxicity_held_out_with_learned_stems(corpus):
    docs, labels, truth = corpus
    assert accuracy(toxicity.score_toxicity(docs, labels).collect(), truth, 2) > 0.95


def test_labels_hold_alike_at_every_size(corpus, monkeypatch):
    docs, labels, _ = corpus
    held = []
    monkeypatch.setattr(toxicity, "fit_label_model", lambda shapes, voters, start, strength: held.append(strength) or start)
    monkeypatch.setattr(toxicity, "fit_classifier", lambda *a: None)
    more = docs.unionByName(docs.crossJoin(docs.sparkSession.range(9)).drop("id").withColumn("doc_id", F.lit(None).cast("long")))
    for d in (docs, more):
        toxicity.score_toxicity(d, labels)
    assert min(held[0]) > 50 and np.allclose(held[1] - 50, 10 * (held[0] - 50))


@pytest.mark.parametrize(("score", "column"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_odd_rows_without_labels(spark, clashing, none, score, column):
    labels = spark.createDataFrame([], f"doc_id long, {column} int")
    out = score(clashing, labels).collect()
    assert len(out) == len(texts()) and all(0 <= r.score <= 1 for r in out)
    assert score(none, labels).count() == 0


def test_held_out_labels_do_not_matter(spark, corpus):
    docs, labels, _ = corpus
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.score_quality(docs, flipped).collect()}
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_held_out_toxicity_labels_do_not_matter(corpus):
    docs, labels, _ = corpus
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, flipped).collect()}
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_label_model_equals_brute_force(spark, corpus):
    """One round of expectation-maximisation over documents, one by one, against the summed one."""
    docs, _, _ = corpus
    rows = docs.limit(60).collect()
    voters = toxicity.Voters()
    for keys in ((" idiot ",), (" grumf",), (" the",), (" ing",), (" idiot ", " grumf")):
        voters.add(keys, 1)
    voters.add((" the",), 5)
    tally = toxicity.Tally(voters)
    votes = tally.votes(tally.counts([r.text.encode() for r in rows]))
    n, start = len(voters.voters), toxicity.LabelModel(np.array([[0.1, 0.05, 0.3, 0.3, 0.1, 0.2], [0.6, 0.5, 0.4, 0.35, 0.7, 0.25]]), np.ones(6), 0.2)
    strength = np.array([7.0, 3.0])
    for row, r in zip(votes, rows):  # the votes themselves
        count = lambda *stems: sum(any(w.startswith(s.strip()) if s[-1] != " " else w == s.strip() for s in stems) for w in toxicity.normal(r.text.encode()).split())  # noqa: E731, B023
        assert row.tolist() == [count(" idiot ") > 0, count(" grumf") > 0, count(" the") > 0, count(" ing") > 0, count(" idiot ", " grumf") > 0, count(" the") >= 5]
    mass, fired, both = [0.0, 0.0], np.zeros((2, n)), np.zeros((2, n, n))
    for v in votes:
        odds = [1 - start.prior, start.prior]
        for k in (0, 1):
            for j in range(n):
                odds[k] *= start.rates[k][j] if v[j] else 1 - start.rates[k][j]
        for k in (0, 1):
            p = odds[k] / sum(odds)
            mass[k] += p
            for i in range(n):
                fired[k, i] += p * v[i]
                for j in range(n):
                    both[k, i, j] += p * v[i] * v[j]
    shapes = docs.limit(60).repartition(3).select("doc_id", "text").mapInArrow(toxicity._shape_stage(voters), "counts binary, n long")
    got = toxicity.next_model(toxicity._sums(shapes, voters, start), start, strength)
    want = [(fired[k] + strength[k] * start.rates[k]) / (mass[k] + strength[k]) for k in (0, 1)]
    assert np.allclose(got.rates[0], want[0]) and np.allclose(got.rates[1], np.maximum(want[1], want[0] * 1.01))
    assert np.isclose(got.prior, (mass[1] + 10 * 0.2) / (60 + 10))
    weight = []
    for i in range(n):
        total = 0.0
        for j in range(n):
            rho = []
            for k in (0, 1):
                a, b, ab = fired[k, i] / mass[k], fired[k, j] / mass[k], both[k, i, j] / mass[k]
                rho.append(min(1, max(0, (ab - a * b) / np.sqrt(max(a * (1 - a), 1e-12)) / np.sqrt(max(b * (1 - b), 1e-12)))))
            total += 1.0 if i == j else max(rho) if max(rho) > 0.1 else 0.0
        weight.append(1 / total)
    assert np.allclose(got.weight, weight)


def test_classifier_is_at_its_optimum(spark, corpus):
    """The gradient of the penalised likelihood of posterior labels, summed document by document, is zero."""
    docs, _, _ = corpus
    voters = toxicity.Voters()
    for keys in ((" idiot ",), (" grumf",), (" the",)):
        voters.add(keys, 1)
    model = toxicity.LabelModel(np.array([[0.01, 0.01, 0.3], [0.6, 0.5, 0.4]]), np.ones(3), 0.2)
    shapes = docs.select("doc_id", "text").mapInArrow(toxicity._shape_stage(voters), "counts binary, n long")
    b = toxicity.fit_classifier(shapes, voters, model)
    tally, gradient = toxicity.Tally(voters), np.zeros(len(b))
    for r in docs.collect():
        counts = tally.counts([r.text.encode()])
        x = toxicity.features(counts)[0]
        p = model.posterior(tally.votes(counts).astype(float))[0]
        gradient += x * (p - 1 / (1 + np.exp(-x @ b)))
    assert np.abs(gradient - np.append(np.full(len(b) - 1, toxicity.RIDGE), 1e-6) * b).max() < 0.05


def test_quality_equals_brute_force(spark, corpus):
    """Shrunk covariances and Mahalanobis differences, computed plainly."""
    docs, labels, truth = corpus
    stats = quality.document_statistics(docs)
    model = quality.fit(stats, quality.training_labels(labels, "quality"))
    x = {r.doc_id: np.array(r.x) for r in stats.collect()}
    own = {y: np.array([x[i] for i, q, _ in truth if q == y and not held(i, 4, 2)]) for y in (0, 1)}
    every = np.concatenate([own[0], own[1]])
    spread = np.sqrt(every.var(axis=0) + 0)
    spread = np.sqrt(np.maximum(spread**2, 1e-9))
    logs = {}
    for y in (0, 1):
        cov = np.cov((own[y] / spread).T, bias=True)
        d, n = len(cov), len(own[y])
        mu, power = np.trace(cov) / d, (cov**2).mean()
        weight = min(1.0, (power + mu**2) / ((n + 1) * (power - mu**2 / d)))
        shrunk = (1 - weight) * cov + (weight * mu + 1e-6) * np.eye(d)
        mean = own[y].mean(axis=0)
        logs[y] = {i: np.log(n / len(every)) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * ((v - mean) / spread) @ np.linalg.solve(shrunk, (v - mean) / spread) for i, v in x.items()}
    ids = list(x)
    margin = model.margin(np.array([x[i] for i in ids]))
    assert np.allclose(margin, [logs[1][i] - logs[0][i] for i in ids], rtol=1e-5, atol=1e-5)


def test_language_model(spark, corpus, none, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", 40)  # so that rare words take the join
    docs, _, _ = corpus
    everything = docs.union(spark.createDataFrame([(1000 if i is None else 600 + i, t) for i, t in texts()], DOC))
    rows = [(r.doc_id, r.text) for r in everything.collect()]
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    words = {i: (t or "").encode().translate(lower).split() for i, t in rows}
    counts, ends = Counter(), 0
    for i, ws in words.items():
        if not held(i, 5, 1):
            counts.update(ws)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    out = maxent.score_documents(everything).collect()
    assert len(out) == len(rows)
    for r in out:
        ws = words[r.doc_id]
        base = sum(math.log10(counts.get(w, 0) + 0.5) for w in ws) + math.log10(ends + 0.5) - (len(ws) + 1) * math.log10(n + 0.5 * (v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 5, 1), len(ws) + 1, sum(w in counts for w in ws) + 1, n)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
    mine = [r for r in out if r.held_out]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)
    assert maxent.score_documents(none).count() == 0


def test_probabilities_add_up():
    weights = np.random.default_rng(1).normal(size=(maxent.HASHED, maxent.CLASSES))
    logp = maxent.log_softmax(weights, np.arange(0, maxent.CONTEXTS, 997))
    assert np.allclose(np.exp(logp).sum(axis=1), 1)


def test_word_features_equal_brute_force(spark, corpus, monkeypatch):
    """What word features add to each score, from pairs of words counted plainly; rare words included."""
    docs, _, _ = corpus
    again = docs.filter("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 2000)  # pairs seen twice
    everything = docs.union(again).union(spark.createDataFrame([(3000, None), (3001, ""), (None, "the the ing tion")], DOC))
    monkeypatch.setattr(maxent, "FREQUENT", 60)
    kept, build = [], maxent.build_vocabulary
    monkeypatch.setattr(maxent, "build_vocabulary", lambda counts: kept.append(build(counts)) or kept[-1])
    full = {r.doc_id: r.score for r in maxent.score_documents(everything).collect()}
    monkeypatch.setattr(maxent, "LEAST_PAIR", 10**9)
    plain = {r.doc_id: r.score for r in maxent.score_documents(everything).collect()}

    v = kept[0]
    rows = {r.doc_id: maxent.tokens((r.text or "").encode()) for r in everything.collect()}
    counts = Counter(w for i, ws in rows.items() if not held(i, 5, 1) for w in ws)
    cls = {w: v.class_of(maxent.word_hash(w), maxent.ending(w)) for ws in rows.values() for w in ws}
    frequent = {w for w in cls if v.count(maxent.word_hash(w)) >= 0}
    assert 0 < len(frequent) < len(cls)

    def share(w):
        return (counts[w] + 0.5) / (v.class_total[cls[w]] + 0.5 * (v.class_distinct[cls[w]] + 1))

    def pairs(ws):
        for j, w in enumerate(ws):
            near = [k for k in (1, 2) if j >= k and cls[ws[j - k]] >= maxent.FIRST]
            if near and cls[w] >= maxent.FIRST and ws[j - 1] != w:
                yield (near[0], ws[j - near[0]]), w

    seen = Counter(x for i, ws in rows.items() if not held(i, 5, 1) for x in pairs(ws))
    twice, thrice = (sum(n == k for n in seen.values()) for k in (2, 3))
    discount = min(1.9, max(0.5, 2 - 3 * thrice / twice))
    every, known = Counter(), {}
    for (u, w), n in seen.items():
        every[u, cls[w]] += n
        if n >= 2:
            known.setdefault((u, cls[w]), {})[w] = n
    other = {}
    for q, ws in known.items():
        p = sum((n - discount) / every[q] for n in ws.values())
        other[q] = (1 - p) / (1 - sum(share(w) for w in ws if w in frequent))
        assert p + other[q] * (1 - sum(map(share, ws))) < 1 + 1e-9
    assert known and set(full) == set(rows)
    for i, ws in rows.items():
        gain = 0.0
        for u, w in pairs(ws):
            q = (u, cls[w])
            if w in known.get(q, {}):
                gain += math.log10((known[q][w] - discount) / every[q] / share(w))
            elif q in known:
                gain += math.log10(other[q])
        assert abs(full[i] - plain[i] - gain) < 1e-6 * max(1, abs(full[i]))


def test_language_model_without_training_rows(spark, odd):
    out = maxent.score_documents(odd).collect()
    assert len(out) == odd.count() and all(r.score < 0 for r in out)
    ids = [i for i in range(400) if held(i, 5, 1)][:5]
    out = maxent.score_documents(spark.createDataFrame([(i, "one two three four") for i in ids], DOC)).collect()
    assert len(out) == 5 and all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in out)
