"""Operators with exact results against brute force, on odd rows and empty tables."""

import hashlib
import re
import zlib
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests_llm_rows import BENCH, OTHER, texts

from revlake.llm import bpe, bpe_arrays, decontaminate, licenses, neardup, queries, secrets, simple8b, webp

LOWER = {c: c + 32 for c in range(65, 91)}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# op1
def test_webp_round_trip_of_texts(docs, clashing, none):
    out = by_id(webp.store_texts(clashing))
    for i, t in texts():
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert webp.load(bytes(r.media)) == payload and r.media_bytes == len(r.media)
    assert webp.store_texts(none).count() == 0
    pixels = webp.decode_media(webp.store_texts(docs)).filter("id = 0").head()
    assert (pixels.width, len(pixels.argb)) == (64, 4 * 64 * pixels.height)


#: Two published lossless files of one pixel, by which programs test for the format.
PUBLISHED = ("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", "UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=")


@pytest.mark.parametrize("text", PUBLISHED)
def test_files_of_another_writer(text):
    import base64

    (image,) = webp.decode(base64.b64decode(text))
    assert image.shape == (1, 1)


def test_what_repeats_becomes_back_references():
    rng = np.random.default_rng(1)
    once = rng.integers(0, 256, 3000, dtype=np.uint8).tobytes()
    payload = webp.payload_of(once + b"between" + once[100:2900] + b"z" * 9000 + once)
    stored = webp.store(payload)
    assert webp.load(stored) == payload and len(stored) < 4500
    argb = np.frombuffer(payload, np.uint8).astype(np.uint32) << 8
    found = webp._repeats(argb)
    assert {far for _, _, far in found} >= {1, 2907} and all((argb[p : p + n] == argb[p - far : p - far + n]).all() if far >= n else True for p, n, far in found)
    assert all(a[0] + a[1] <= b[0] for a, b in zip(found, found[1:]))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000), st.integers(1, 3))
def test_webp_any_bytes(data, times):
    payload = webp.payload_of(data * times)
    assert webp.load(webp.store(payload)) == payload


def _stream(argb, transforms=(), cache_bits=0, groups=0, tokens=None):
    """A VP8L stream written plainly: transforms, an optional cache, and given tokens."""
    h, w_ = argb.shape
    w = webp.Writer()
    w.put(0x2F, 8), w.put(w_ - 1, 14), w.put(h - 1, 14), w.put(1, 1), w.put(0, 3)
    for kind, *rest in transforms:
        w.put(1, 1), w.put(kind, 2)
        if kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
            w.put(rest[0] - 2, 3)
            webp.write_samples(w, rest[1].reshape(-1).astype(np.uint32), main=False)
    w.put(0, 1)
    if tokens is None and not groups:
        webp.write_samples(w, argb.reshape(-1).astype(np.uint32))
        return w.bytes()
    if cache_bits:
        w.put(1, 1), w.put(cache_bits, 4)
    else:
        w.put(0, 1)
    if groups:
        w.put(1, 1), w.put(0, 3)  # blocks of 4 x 4
        meta = np.arange(((w_ + 3) // 4) * ((h + 3) // 4), dtype=np.uint32) % groups << 8
        webp.write_samples(w, meta, main=False)
    else:
        w.put(0, 1)
    flat = argb.reshape(-1)
    tokens = tokens or [("pixel", p) for p in flat.tolist()]
    sizes = [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    flat_code = [np.full(256, 8)] * 4
    lengths = np.full(sizes[0], 0)
    lengths[: min(512, sizes[0])] = 9
    if sizes[0] < 512:  # make the code complete with a few shorter words
        spare = 512 - sizes[0]
        lengths[:spare] = 8
    dist = np.full(40, 5)
    dist[8:] = 6
    dist[:24], dist[24:] = 5, 6
    codes = []
    for _ in range(max(1, groups)):
        codes = [webp.write_code(w, x) for x in (lengths, *flat_code[1:], dist)]
    at = 0
    for kind, *rest in tokens:
        if kind == "pixel":
            p = int(rest[0])
            for k, v in ((0, p >> 8 & 255), (1, p >> 16 & 255), (2, p & 255), (3, p >> 24)):
                w.put(int(codes[k][0][v]), int(codes[k][1][v]))
        elif kind == "back":
            for k, value, base in ((0, rest[0], 256), (4, rest[1], 0)):
                s, extra, n = webp.prefix_of(value)
                w.put(int(codes[k][0][base + s]), int(codes[k][1][base + s]))
                if n:
                    w.put(extra, n)
        else:
            w.put(int(codes[0][0][280 + rest[0]]), int(codes[0][1][280 + rest[0]]))
        at += 1
    return w.bytes()


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(1).integers(0, 2**32, (13, 19), dtype=np.uint32)


def test_webp_colour_channels_and_groups(image):
    assert (webp.decode_vp8l(_stream(image)) == image).all()
    assert (webp.decode_vp8l(_stream(image, groups=3)) == image).all()


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(image, mode):
    modes = np.full((4, 5), mode << 8, np.uint32)
    residual = webp._predictor(image, 2, modes, forward=True)
    assert (webp.decode_vp8l(_stream(residual, [(webp.PREDICTOR, 2, modes)])) == image).all()


def test_webp_all_transforms(image):
    rng = np.random.default_rng(2)
    modes = rng.integers(0, 14, (4, 5)).astype(np.uint32) << 8
    elements = rng.integers(0, 2**24, (2, 3)).astype(np.uint32)
    step = webp._subtract_green(image, forward=True)
    step = webp._cross_colour(step, 3, elements, forward=True)
    step = webp._predictor(step, 2, modes, forward=True)
    order = [(webp.SUBTRACT_GREEN,), (webp.CROSS_COLOUR, 3, elements), (webp.PREDICTOR, 2, modes)]
    assert (webp.decode_vp8l(_stream(step, order)) == image).all()


def test_webp_back_references_and_cache():
    a, b = 0xFF102030, 0x01AABBCC
    slot = (a * webp.CACHE_MULTIPLIER & 0xFFFFFFFF) >> 28
    tokens = [("pixel", a), ("pixel", b), ("back", 6, 122), ("cache", slot), ("back", 3, 2), ("back", 4, 1)]
    # Two pixels, six more at distance 2, one from the cache, three of the pixel before, four of the row above (width 4).
    expected = [a, b] * 4 + [a] + [a] * 3 + [a] * 4
    expected = np.array(expected, np.uint32)
    expected[12:] = expected[8:12]
    out = webp.decode_vp8l(_stream(expected.reshape(4, 4), cache_bits=4, tokens=tokens))
    assert (out.reshape(-1) == expected).all()


@pytest.mark.parametrize("bad", [b"", b"\x2f", b"\x00" * 20, b"\x2f\x00\x00\x00\x00"])
def test_webp_rejects_garbage(bad):
    with pytest.raises((ValueError, IndexError)):
        webp.decode_vp8l(bad)


# op5, op7
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_library(clashing, none, library):
    out = by_id(bpe.encode_documents(clashing, outputs=("ids", "decoded", "ids_sha256", "decoded_sha256")))
    for i, t in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = out[i]
        assert (list(r.ids), r.decoded, r.n_tokens) == (ids, decoded, len(ids)), i
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_documents(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("theingandor's !.#é<|>123")), st.characters(codec="utf-8")), max_size=60))
def test_bpe_any_text(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    mine = np.frombuffer(bpe.encoder(bpe.default_vocabulary()).encode(text.encode()), "<u4")
    assert mine.tolist() == ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 70), st.integers(0, 2**17), st.integers(0, 2**64 - 1)), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_simple8b_round_trip(values, lo, hi):
    data = np.array(values, np.uint64)
    words, table = simple8b.pack(data)
    assert simple8b.unpack(words, table, len(data)).tolist() == values
    assert simple8b.unpack(words, table, len(data), lo, hi).tolist() == values[lo:hi]


def test_simple8b_many_blocks():
    data = np.random.default_rng(0).integers(0, 50_000, 3 * simple8b.BLOCK + 17, dtype=np.uint64)
    words, table = simple8b.pack(data)
    assert (simple8b.unpack(words, table, len(data)) == data).all()
    assert (simple8b.unpack(words, table, len(data), simple8b.BLOCK - 3, simple8b.BLOCK + 5) == data[simple8b.BLOCK - 3 : simple8b.BLOCK + 5]).all()


def test_token_files(spark, clashing, none, library, tmp_path):
    simple8b.write_tokens(clashing, f"file://{tmp_path}/t", partitions=3)
    out = by_id(simple8b.read_tokens(spark, f"file://{tmp_path}/t"))
    start = 0
    for i, t in sorted(texts(), key=lambda x: -1 if x[0] is None else x[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    simple8b.write_tokens(none, f"file://{tmp_path}/e")
    assert simple8b.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


ANY_TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("theingandorİßÉ²½ªǄȺɏ's !.#é<|>123\x85\xa0\x1c\t")), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(ANY_TEXT, max_size=8), st.integers(1, 12))
def test_texts_at_once_equal_library(library, some, remembered):
    enc = bpe_arrays.array_encoder(bpe.default_vocabulary(), 450_000)
    enc.remembered = remembered  # so the table turns over all the time
    ids, counts = enc.encode([t.encode() for t in some], 2)
    whole = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in some]
    assert ids.tolist() == [i for w in whole for i in w]
    assert counts.tolist() == [len(w) for w in whole]


def test_texts_at_once_special_and_long(library):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeéßñ"), rng.integers(1, 100))) for _ in range(3000)]
    some = ["<|endoftext|> a<|startoftext|>b <|end", "", " \n ", "I'm they'll 'tis O'REILLY'S", "x" * 5000, " ".join(words), "ΑΣ привет 漢字 e\u0301", "aaaa " * 50]
    enc = bpe_arrays.ArrayEncoder(bpe.encoder(bpe.default_vocabulary()), 100)
    for _ in range(2):  # the second time partly from the table
        ids, counts = enc.encode([t.encode() for t in some], 2)
        whole = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in some]
        assert ids.tolist() == [i for w in whole for i in w]
        assert counts.tolist() == [len(w) for w in whole]


def test_token_files_do_not_merge_word_by_word(library, monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext

    calls, word = [], bpe.Encoder.word
    monkeypatch.setattr(bpe.Encoder, "word", lambda self, text: (calls.append(text), word(self, text))[1])
    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(11)
    some = [" ".join("".join(rng.choice(list("etaoinshrdluéü"), 12)) for _ in range(200)) for _ in range(10)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(10), pa.int64()), "text": pa.array(some)})
    (segment,) = simple8b._segments(None, 2)(iter([batch]))
    r = segment.to_pylist()[0]
    ids = [i for t in some for i in [*library.encode(t, add_special_tokens=False).ids, 2]]
    assert simple8b.unpack(r["words"], r["table"], r["tokens"]).tolist() == ids
    assert len(calls) < 20, "words that no table holds were encoded one by one"


# op6
def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_components(rows):
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)]


def test_near_duplicates_equal_brute_force(spark, clashing, none):
    out = {(r.doc_id): r for r in neardup.near_duplicates(clashing).collect()}
    for i, n, component in brute_components(texts()):
        r = out[i]
        assert (r.n_shingles, r.component_id, r.kept) == (n, component, i is not None and i == component), i
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("cross", "members", "few"), [(6, 300, 3), (10**6, 10**6, 32)])
def test_near_duplicate_families_and_large_nodes(spark, monkeypatch, cross, members, few):
    # Chains of edits around one text, with nodes above SMALL so that branching and blocks are used.
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "MEMBERS", members)
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "CROSS", cross)
    monkeypatch.setattr(neardup, "DEPTH", 2)
    rng = np.random.default_rng(3)
    rows = []
    for family in range(3):
        words = [f"f{family}w{i}" for i in range(120)]
        for k in range(14):
            changed = list(words)
            for at in rng.integers(0, 120, k // 2):
                changed[at] = f"x{rng.integers(1e6)}"
            rows.append((len(rows), " ".join(changed)))
    out = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: c for i, _, c in brute_components(rows)}


def test_components_both_ways(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    a, b = np.concatenate([a, np.arange(500, 560)]), np.concatenate([b, np.arange(501, 561)])  # and a long chain
    ends, comp = neardup.least_labels(a, b)
    parent = {int(x): int(x) for x in ends}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        parent[max(find(x), find(y))] = min(find(x), find(y))
    expected = {x: find(x) for x in parent}
    assert dict(zip(ends.tolist(), comp.tolist())) == expected
    links = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    for f in (neardup.components, neardup.propagated):
        assert {r.cid: r.comp for r in f(links).collect()} == expected


# op8
def brute_spans(text):
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_equal_brute_force(clashing, none):
    out = by_id(secrets.scan_secrets(clashing).select("doc_id", secrets.spans_text("base").alias("base"), secrets.spans_text("spans").alias("spans")))
    for i, t in texts():
        assert out[i].base == brute_spans(t or ""), i
        assert set(filter(None, out[i].base.split(","))) <= set(out[i].spans.split(","))
    assert secrets.scan_secrets(none).count() == 0


def test_randomness_battery_and_discovery_control(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list(secrets.ALPHABETS["base62"]))
    random = ["".join(rng.choice(letters, 40)) for _ in range(300)]
    p = np.array([secrets.battery(s)[1] for s in random])
    assert 0.3 < (p > 0.5).mean() < 0.75 and secrets.battery("a" * 40)[1] < 1e-6 and secrets.battery("internationalisationandlocalisationagain")[1] < 0.05
    words = ["".join(rng.choice(list("the-and-ing-ion-er"), 40)) for _ in range(300)]
    rows = [(k, f"x {s} y") for k, s in enumerate(random + words)]
    found = {r.doc_id for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).filter(F.size("spans") > 0).collect()}
    assert len([i for i in found if i < 300]) > 150 and len([i for i in found if i >= 300]) <= 0.1 * len(found)


def flagged(spark, strings):
    """The strings with a span, each in a document of its own."""
    rows = [(k, f"x {s} y") for k, s in enumerate(strings)]
    out = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).filter(F.size("spans") > 0)
    return {strings[r.doc_id] for r in out.select("doc_id").collect()}


def test_copies_of_a_string_do_not_move_its_threshold(spark):
    rng = np.random.default_rng(8)
    keys = ["".join(rng.choice(list(secrets.ALPHABETS["base62"]), 40)) for _ in range(200)]
    by_p = sorted(keys, key=lambda s: secrets.battery(s)[1])
    once = flagged(spark, keys)
    low = next(s for s in by_p if s in once)
    assert secrets.battery(low)[1] < 0.4 and len(once) > 150
    assert flagged(spark, keys + [low] * 3000) == once  # else no lower one is found, nor itself
    slugs = ["".join(rng.choice(list("abcde-"), 40)) for _ in range(200)]
    natural = sorted(slugs, key=lambda s: secrets.battery(s)[1])
    assert flagged(spark, slugs + [natural[-1]] * 3000) == flagged(spark, slugs)


def test_few_candidates_take_the_fallback(spark):
    rng = np.random.default_rng(9)
    keys = ["".join(rng.choice(list(secrets.ALPHABETS["BASE36"]), 40)) for _ in range(20)]
    key = next(s for s in keys if 0.2 < secrets.battery(s)[1] < 0.5)
    assert flagged(spark, [key] * 30 + ["internationalisationandlocalisationagain"]) == {key}
    few = [dict(encoding="hex", length=n, bin=40, count=c) for n, c in ((20, 60), (40, 1))]
    assert secrets.thresholds(few) == {("hex", 20): 0, ("hex", 40): 0}  # by the encoding
    assert secrets.thresholds(few[1:]) == {("hex", 40): secrets.FALLBACK}


def brute_random(strings):
    """Strings above their class's threshold, by a plain reading of the rule; each is the only candidate of its text."""
    judged = {s: secrets.battery(s) for s in strings}
    length = lambda s: max(n for n in secrets.LENGTHS if n <= len(s))

    def least(group):
        bins = [int(judged[s][1] * secrets.BINS) for s in group]
        bins = [min(b, secrets.BINS - 1) for b in bins]
        random = 2 * sum(b >= secrets.BINS // 2 for b in bins)
        for lo in range(secrets.BINS):
            total = sum(b >= lo for b in bins)
            if random and total and total - random * (secrets.BINS - lo) / secrets.BINS <= secrets.RATE * total:
                return lo
        return secrets.BINS

    out = set()
    for s in judged:
        same = [x for x in judged if judged[x][0] == judged[s][0]]
        group = [x for x in same if length(x) == length(s)]
        lo = least(group) if len(group) >= secrets.LEAST_CLASS else least(same) if len(same) >= secrets.LEAST_CLASS else secrets.FALLBACK
        if min(int(judged[s][1] * secrets.BINS), secrets.BINS - 1) >= lo:
            out.add(s)
    return out


def test_added_spans_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    draw = lambda a, n, k: ["".join(rng.choice(list(a), n)) for _ in range(k)]
    strings = draw(secrets.ALPHABETS["base62"], 40, 80) + draw("abcdefgh", 26, 60) + draw(secrets.ALPHABETS["base36"], 70, 30) + draw(secrets.ALPHABETS["base36"], 30, 30) + draw(secrets.ALPHABETS["BASE36"], 22, 5)
    assert flagged(spark, strings + strings[:7]) == brute_random(strings)


def test_dependent_tests_give_even_values():
    """Evenly drawn strings have evenly spread combined values, whatever the tests have in common."""
    import random

    rng = random.Random(4)
    for name, n in (("base62", 40), ("lower", 20), ("digits", 24)):
        p = np.array([secrets.battery("".join(rng.choices(secrets.ALPHABETS[name], k=n)))[1] for _ in range(600)])
        assert all(abs((p < q).mean() - q) < 0.08 for q in (0.1, 0.25, 0.5, 0.75, 0.9)), name


def test_redaction(docs):
    out = by_id(secrets.redact(docs))
    assert out[14].text == f"x {secrets.MARK}\" y" and out[14].n_chars == len(out[14].text)
    assert out[0].text == texts()[0][1] and out[3].text is None


# op9, op10
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def test_licenses_equal_brute_force(clashing, none):
    out = by_id(licenses.scan_licenses(clashing))
    for i, t in texts():
        ws, places, labels = words(t), [], set()
        for phrase, label in PHRASES:
            p = phrase.split()
            for k in range(len(ws)):
                if ws[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))), i
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "mit" in out[16].labels.split(",") and {"gpl-3.0", "cc-by-nc"} <= set(out[17].labels.split(",")) and out[0].labels == ""
    assert len(licenses.rules()) > 300 and licenses.scan_licenses(none).count() == 0


def samples(parsed, full):
    """Texts of a parsed expression: one for each choice of branches, optional parts all there or all left out."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        elif name == "BRANCH":
            more = [x for branch in arg[1] for x in samples(branch, full)]
        elif name == "SUBPATTERN":
            more = samples(arg[3], full)
        elif name == "MAX_REPEAT":
            low, high, inner = arg
            more = [x * (high if full else low) for x in samples(inner, full)] if full or low else [""]
        else:  # what stands around
            more = [""]
        out = [a + b for a in out for b in more]
    return out


def alone():
    """(label, text) for every rule and branch, of nothing but what the rule matches."""
    return sorted({(label, x.strip()) for label, _, e, _ in licenses.rules() for full in (False, True) for x in samples(re._parser.parse(e), full)})


def test_every_license_rule_fires_on_its_own_text(spark):
    for label, keys, e, _ in licenses.rules():
        for full in (False, True):
            for x in samples(re._parser.parse(e), full):
                assert re.search(e, f" {x.strip()} ") and any(k in f" {x.strip()} " for k in keys), (label, x)
    for _, label, keys, e, _, also in licenses.ranked_rules():
        assert all(any(a in k for a in licenses.anchors()) for k in keys)
        for full in (False, True):
            assert not also or all(any(k in x for k in also) for x in samples(re._parser.parse(e), full)), (label, e, also)
    own = alone()
    out = by_id(licenses.scan_licenses(spark.createDataFrame([(k, x) for k, (_, x) in enumerate(own)], "doc_id long, text string")))
    # The name of mpl-2.0 may lack its number, and its rules come before those of mpl-1.1.
    missed = [own[k] for k, r in out.items() if own[k][0] not in r.labels.split(",") and not (own[k][0] == "mpl-1.1" and "mpl-2.0" in r.labels)]
    assert not missed, (len(missed), len(own), missed[:20])


def brute_detections(text):
    """All matches of all rules, then pairwise: an interval within one of higher priority, or within a longer or earlier one of the same, goes."""
    line = " " + " ".join(words(text)) + " "
    found = []
    for k, (p, label, _, e, _, _) in enumerate(licenses.ranked_rules()):
        for m in re.finditer(e, line):
            found.append((line[: m.start()].count(" ") - 1, line[: m.end()].count(" "), p, k, label))
    within = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and (y[2] > x[2] or (y[2] == x[2] and (x[:2] != y[:2] or y[3] < x[3])))
    return sorted((x[4], x[0], x[1]) for x in found if not any(within(x, y) for y in found))


def test_license_intervals_equal_brute_force(spark):
    texts = [
        "released under the apache license 2.0 or the GPL 3.0 license", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "GNU Lesser General Public License v2.1, see the GNU General Public License, version 3 of the License", "cc by nc sa 4.0 cc by " * 30, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "MIT License. Copyright (c) 2020 X. All rights reserved. SPDX-License-Identifier: MIT. Available under the MIT license or the BSD 3 clause license.", "word " * 50, "",
        "license mit license mit license", "all rights reserved " * 700 + "public domain",
    ]
    rng = np.random.default_rng(6)
    bits = ["the gnu", "general public license", "lesser general public license", "version 3", "2 0", "apache", "license", "under the terms of the", "released", "licensed", "mit", "cc by", "nc", "all rights reserved", "is", "under the", "or", "creative commons attribution"]
    texts += [" ".join(rng.choice(bits, 14)) for _ in range(60)]
    out = by_id(licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for k, t in enumerate(texts):
        assert sorted((x.label, x.start, x.end) for x in out[k].detections) == brute_detections(t), t
    assert {"apache-2.0", "gpl-3.0"} <= set(out[0].labels.split(","))


def test_licenses_need_no_other_word(spark):
    texts = ["Released under the MIT.", "Distributed under the 3-clause BSD", "available under Apache 2.0", "governed by the ISC"]
    out = by_id(licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [out[k].labels for k in range(4)] == ["mit", "bsd-3-clause", "apache-2.0", "isc"]


def test_license_identifiers_and_names(spark):
    texts = ["SPDX-License-Identifier: GPL-3.0-or-later", "// SPDX-License-Identifier: MPL-2.0", "licensed under Creative Commons Attribution 4.0", "https://opensource.org/licenses/EPL-2.0"]
    out = by_id(licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [out[k].labels for k in range(4)] == ["gpl-3.0", "mpl-2.0", "cc-by", "epl-2.0"] and min(r.score for r in out.values()) >= 0.9


def bench(spark):
    return spark.createDataFrame([(1, BENCH), (22, OTHER), (3, "word40 word41"), (4, None), (5, ""), (None, BENCH)], "item_id long, text string")


def brute_hits(text, items):
    ws, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(8, len(b))
        for k in range(len(b) - n + 1 if n else 0):
            for at in range(len(ws) - n + 1):
                if ws[at : at + n] == b[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(str(item))
    return sorted(hit), sorted(found)


@pytest.mark.parametrize("block", [2_000_000, 5])
def test_decontamination_equals_brute_force(spark, clashing, none, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    out = by_id(decontaminate.scan_documents(clashing, bench(spark)))
    for i, t in texts():
        hits, items = brute_hits(t, [(1, BENCH), (22, OTHER), (3, "word40 word41")])
        assert (out[i].n_words, sorted(out[i].hits), sorted(out[i]["items"])) == (len(words(t)), hits, items), i
    assert decontaminate.scan_documents(none, bench(spark)).count() == 0
    assert decontaminate.scan_documents(clashing, bench(spark).limit(0)).filter(F.size("items") > 0).count() == 0


def test_decontaminated_documents(spark, docs):
    out = by_id(decontaminate.decontaminate(docs, bench(spark).filter("item_id in (1, 22)")))
    assert 11 not in out and out[12].text == "only " and out[12].n_chars == 5 and out[3].text is None
    assert out[0].text == texts()[0][1]


@pytest.mark.parametrize("block", [2_000_000, 5])
def test_items_without_id_count(spark, docs, monkeypatch, tmp_path, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    named = spark.createDataFrame([(1, BENCH), (None, OTHER), (None, "word40 word41"), (3, "word40 word41"), (3, "word50 word51")], "item_id long, text string")
    docs.filter("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    named.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in queries.op10_decontaminate(spark, str(tmp_path)).collect()}
    assert (rows[11].n_items, rows[12].n_items, rows[0].n_items, rows[11].contaminated) == (2, 1, 2, True)
    assert rows[11].n_hit == len(set(brute_hits(texts()[11][1], [(1, BENCH), (None, OTHER)])[0]))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = db.sql(queries.ORACLES["op10_decontaminate"])
    assert sorted(found.fetchall()) == sorted(tuple(r[c] for c in found.columns) for r in rows.values())
    kept = by_id(decontaminate.decontaminate(docs, named.filter("text like 'seven%'")))
    assert kept[11].text == f"start {BENCH} middle  end"
