"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

*Patterns.* Assignments of a secret, access key ids and long hexadecimal strings.

*Battery.* Every maximal run of ``LEAST`` or more letters, digits and ``+/_-`` (a
closing ``=`` aside) is a candidate. Its encoding is the smallest of ``ALPHABETS``
that holds its characters. Under the hypothesis that it is drawn evenly from that
alphabet, four tests give probabilities: chi-squared over equal cells of the
alphabet, the number of distinct characters, the number of runs above and below the
middle, and the correlation of neighbours. Their logarithms are added up. The tests
depend on each other, so the sum is compared with a chi-squared curve whose scale and
degrees of freedom follow from the mean and variance of ``DRAWS`` evenly drawn strings
of the same encoding and length class, made from a fixed seed. Natural strings have combined values near 0, random ones any value alike.

*False discoveries.* For each encoding and length class, a histogram over the
distinct candidates of the whole corpus shows both kinds: twice the candidates above
one half are random ones, spread evenly; what exceeds that further down is natural.
The least value is taken from which on at most ``RATE`` of the class's candidates
are natural by this estimate. A class in which no value does so flags nothing. A
class of fewer than ``LEAST_CLASS`` candidates takes the value of its encoding over
all lengths, and an encoding of fewer the fixed bin ``FALLBACK``.

Two passes over the texts: one for the histogram, one that gives spans. Extra columns
do not matter; ``redact`` returns them as they are. An empty table gives no rows, an
empty text no spans; texts of any length are scanned whole.

Null text: no spans. Ties and repeated rows are scanned alike; ids may be null.
Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from math import erfc, exp, lgamma, log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import LOWER, batches, bounded_batches, changed

# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}=*")
#: Encodings from small to large, each with its characters in their order.
_UPPER, _LOWER_, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "digits": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER_,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER_,
    "BASE36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER_ + _DIGITS,
    "base64": _UPPER + _LOWER_ + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER_ + _DIGITS + "-_",
    "other": _UPPER + _LOWER_ + _DIGITS + "+/-_",
}
_INDEX = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
_SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}
#: Lower ends of the length classes, and bins of the combined value.
LENGTHS = (20, 24, 32, 40, 64, 128)
BINS = 50
RATE = 0.05
#: Distinct candidates to estimate from, and the least bin where there are fewer.
LEAST_CLASS = 50
FALLBACK = 5
#: Evenly drawn strings that the combined value is compared with.
DRAWS = 999


def chi_squared_tail(x: float, k: float) -> float:
    """P(chi-squared of k degrees > x), by the incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:  # series
        term = total = 1 / a
        n = a
        while term > total * 1e-12:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * exp(a * log(x) - x - lgamma(a)))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)  # continued fraction
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return min(1.0, h * exp(a * log(x) - x - lgamma(a)))


def encoding_of(s: str) -> str:
    used = set(s)
    return next((name for name, a in _SETS.items() if used <= a), "other")


def statistic(s: str, name: str) -> float:
    """The sum of the tests' logarithms, negative; large where ``s`` does not look evenly drawn."""
    index, size, n = _INDEX[name], len(ALPHABETS[name]), len(s)
    x = [index[c] for c in s]
    # Uniformity over cells that hold about five characters each.
    cells = max(2, min(size, n // 5))
    expected, seen = [0.0] * cells, [0] * cells
    for i in range(size):
        expected[i * cells // size] += n / size
    for v in x:
        seen[v * cells // size] += 1
    even = chi_squared_tail(sum((o - e) ** 2 / e for o, e in zip(seen, expected)), cells - 1)
    # Cells of letters and digits hide how few distinct characters there are, so those count too.
    distinct = len(set(x))
    none, two = (1 - 1 / size) ** n, (1 - 2 / size) ** n
    spread = sqrt(max(1e-9, size * none * (1 - none) + size * (size - 1) * (two - none * none)))
    few = 0.5 * erfc((size * (1 - none) - distinct) / spread / sqrt(2))
    # Runs above and below the middle of the alphabet.
    high = [2 * v >= size for v in x]
    n1 = sum(high)
    n0 = n - n1
    if n0 and n1:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mu = 2 * n0 * n1 / n + 1
        run = erfc(abs(runs - mu) / sqrt(2 * max(1e-9, (mu - 1) * (mu - 2) / (n - 1))))
    else:
        run = 2.0 ** (1 - n)
    # Correlation of neighbours.
    m = sum(x) / n
    var = sum((v - m) ** 2 for v in x)
    serial = erfc(abs(sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / var * sqrt(n)) / sqrt(2)) if var else 0.0
    return -sum(log(max(p, 1e-300)) for p in (even, few, run, serial))


@functools.lru_cache(maxsize=None)
def drawn(name: str, length: int) -> tuple[float, float]:
    """Scale and degrees of freedom of the chi-squared curve that has the mean and the variance
    of evenly drawn strings' statistics: dependent tests spread wider than independent ones."""
    rng = random.Random(f"{name}:{length}")
    sums = [2 * statistic("".join(rng.choices(ALPHABETS[name], k=length)), name) for _ in range(DRAWS)]
    mean = sum(sums) / DRAWS
    variance = sum((x - mean) ** 2 for x in sums) / (DRAWS - 1)
    return variance / (2 * mean), 2 * mean * mean / variance


def battery(s: str) -> tuple[str, float]:
    """The inferred encoding of ``s`` and how well evenly drawn characters explain it."""
    s = s.rstrip("=")
    name = encoding_of(s)
    scale, degrees = drawn(name, length_class(len(s)))
    return name, chi_squared_tail(2 * statistic(s, name) / scale, degrees)


def base_spans(text: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap in each kind."""
    s = text.decode()
    out = []
    lowered = text.translate(LOWER)
    if any(k in lowered for k in KEYWORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(s) if len(m.group(2)) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(s) if m.end() - m.start() >= 16]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(s)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def hash_of(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big", signed=True)


def length_class(n: int) -> int:
    return max(x for x in LENGTHS if x <= n)


@functools.lru_cache(maxsize=100_000)
def judged(s: str) -> tuple[str, int, int]:
    """Encoding, length class and bin of a candidate."""
    name, p = battery(s)
    return name, length_class(len(s)), min(BINS - 1, int(p * BINS))


def _candidate_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every candidate's class, bin and hash, copies in a batch left out."""
    for _, texts in batches(it):
        found = sorted({m for t in texts for m in CANDIDATE.findall(t.decode())})
        rows = [(*judged(m), hash_of(m)) for m in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["encoding", "length", "bin", "hash"])


def least_bin(counts: list[int]) -> int | None:
    """The least bin from which on at most RATE of the candidates are natural."""
    random = 2 * sum(counts[BINS // 2 :])
    for lo in range(BINS):
        total = sum(counts[lo:])
        if random and total and total - random * (BINS - lo) / BINS <= RATE * total:
            return lo
    return None


def thresholds(histogram: list) -> dict[tuple[str, int], int]:
    """The least bin from which on a class's candidates count as random, by (encoding, length)."""
    table: dict[tuple[str, int], list[int]] = {}
    whole: dict[str, list[int]] = {}
    for r in histogram:
        table.setdefault((r["encoding"], r["length"]), [0] * BINS)[r["bin"]] += r["count"]
        whole.setdefault(r["encoding"], [0] * BINS)[r["bin"]] += r["count"]
    out = {}
    for key, counts in table.items():
        enough = [c for c in (counts, whole[key[0]]) if sum(c) >= LEAST_CLASS]
        lo = least_bin(enough[0]) if enough else FALLBACK
        if lo is not None:
            out[key] = lo
    return out


def learned(docs: DataFrame) -> dict[tuple[str, int], int]:
    """Thresholds from the distinct candidates of all texts; a string counts once, however often it is copied."""
    found = docs.select("text").mapInArrow(_candidate_stage, "encoding string, length int, bin int, hash long")
    # At most one row for each encoding, length class and bin.
    histogram = found.distinct().groupBy("encoding", "length", "bin").count().collect()
    return thresholds([r.asDict() for r in histogram])


def spans_of(text: bytes, least: dict[tuple[str, int], int]) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and these with the random strings that overlap none of them."""
    base = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text.decode()):
        name, length, at = judged(m.group())
        if at >= least.get((name, length), BINS) and not any(a < m.end() and m.start() < b for a, _, b in base):
            more.append((m.start(), "random", m.end()))
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and all spans (start, kind, end) of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast(learned(docs))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for batch, texts in batches(it):
            found = [spans_of(t, shared.value) for t in texts]
            base, every = ([[dict(start=a, kind=k, end=b) for a, k, b in spans[j]] for spans in found] for j in (0, 1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "base": pa.array(base, kind), "spans": pa.array(every, kind)})

    span = "array<struct<start:bigint,kind:string,end:bigint>>"
    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, base {span}, spans {span}")


def spans_text(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


MARK = "[secret]"


def cut_spans(text: str, spans: list[tuple[int, str, int]]) -> str:
    """``text`` with MARK in place of every span; spans that overlap are one."""
    out, at = [], 0
    for start, _, end in sorted(spans, key=lambda s: (s[0], s[2])):
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with every secret replaced by MARK in text, and n_chars (a number) to match."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(learned(docs))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            text, n = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else None
            for k, t in enumerate(texts):
                spans = spans_of(t, shared.value)[1]
                if spans:
                    text[k] = cut_spans(text[k], spans)
                    if n is not None:
                        n[k] = len(text[k])
            values = {"text": pa.array(text, batch.schema.field("text").type)}
            if n is not None:
                values["n_chars"] = pa.array(n, batch.schema.field("n_chars").type)
            yield changed(batch, values)

    return docs.mapInArrow(run, docs.schema)
