"""Exact byte-pair encoding by backtracking over longest matches, and decoding.

A word is encoded without replaying merges: an Aho-Corasick automaton over the
vocabulary gives the longest token at each place, a token may follow another
only if the pair is *compatible* (merging their concatenation yields just these
two), and an incompatible choice falls back to the next shorter token or to the
place before. Each place is given up at most once, so the work is linear in the
word's length, and the result equals that of the merge procedure.

Texts are cut at ASCII white space; no token of the vocabulary crosses it, so
pieces are encoded independently and remembered in a bounded table. Decoding
gathers token strings out of one byte string through an offset table.

Null text counts as empty; an empty text has no tokens. Repeated rows give
repeated rows. Null ids are kept.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from revlake.llm.common import batches, bounded_batches

#: Entries of each table of remembered pieces and words. A full table becomes the
#: older of two, from which what is used again moves to the new one. An entry takes some
#: 200 bytes, and there are four tables a worker.
REMEMBERED = 150_000

#: The vocabulary's own split pattern.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class OffsetTable:
    """Byte strings by id: one blob, and where each string starts."""

    def __init__(self, strings: list[bytes]):
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.offsets = np.cumsum([0, *map(len, strings)]).astype(np.int64)
        self.lengths = np.diff(self.offsets).astype(np.int32)

    def gather(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of ``ids`` one after another, and where each one ends."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths, dtype=np.int64)
        if not len(ids):
            return b"", ends
        places = np.repeat((self.offsets[ids] - (ends - lengths)).astype(np.int32), lengths)
        places += np.arange(len(places), dtype=np.int32)
        return self.blob[places].tobytes(), ends


class Encoder:
    END = "</w>"

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, vocab = path, spec["model"]["vocab"]
        self.letter = byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letter)}

        def symbols(token: str) -> str:
            last = token.endswith(self.END)
            chars = [byte_of[c] for c in (token[: -len(self.END)] if last else token)]
            if last:
                chars[-1] += 256
            return "".join(map(chr, chars))

        strings = dict(vocab)
        self.id_of = {symbols(t): i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        strings.update(self.special)
        size = max(strings.values()) + 1
        names = [b""] * size
        for t, i in strings.items():
            names[i] = t.encode()
        self.names = OffsetTable([n + b" " for n in names])
        self.decimals = OffsetTable([f"{i} ".encode() for i in range(size)])
        self.length = [0] * size
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        self.halves = [(i, i) for i in range(size)]
        self.pair = {}
        for left, right in spec["model"]["merges"]:
            a, b, both = vocab[left], vocab[right], vocab[left + right]
            self.pair[a, b] = both
            self.halves[both] = (a, b)
        self.automaton = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            self.length[i] = len(s)
            self.automaton.add_word(s, i)
            self.shorter[i] = next((self.id_of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.id_of), -1)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.older_pieces: dict[bytes, bytes] = {}
        self.library = None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the concatenation of tokens ``a`` and ``b`` stops at the two."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > self.remembered:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b, len(self.length))
        return known

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        # Undo the later of the two last merges until neither can be undone; a
        # merge across the border that comes before what was undone breaks the pair.
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < limit:
                return False
            for side in ((0, 1) if a > b else (1, 0)):
                token = (a, b)[side]
                part = self.halves[token][1 - side]
                if part != token:
                    limit = token + side
                    a, b = (part, b) if side == 0 else (a, part)
                    break
            else:
                return True

    def word(self, text: str) -> list[int]:
        """Token ids of one word of the split pattern."""
        data = text.encode()
        s = data[:-1].decode("latin-1") + chr(256 + data[-1])
        whole = self.id_of.get(s)
        if whole is not None and self._reachable(whole):
            return [whole]
        n, length, fits = len(s), self.length, self.fits
        longest = [0] * (n + 1)
        for end, token in self.automaton.iter(s):
            longest[end + 1 - length[token]] = token
        out, at, closed, token, last = [], 0, set(), longest[0], -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if end not in closed:
                    if last < 0:
                        break
                    fit = fits.get(last << 20 | token)
                    if self.compatible(last, token) if fit is None else fit:
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at, last, token = end, token, longest[end]
            else:
                closed.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def _reachable(self, token: int) -> bool:
        """Whether the merge procedure on a token's own letters ends in it."""
        known = self.whole.get(token)
        if known is None:
            a, b = self.halves[token]
            known = self.whole[token] = a == b == token or (self._reachable(a) and self._reachable(b) and self._compatible(a, b, token))
        return known

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            return [text.lower()] if text.isalpha() else SPLIT.findall(text.lower())
        if max(text) < "ɐ":  # Latin letters, on which every Unicode version agrees
            return SPLIT.findall(unicodedata.normalize("NFC", text).lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        byte_of = {c: b for b, c in enumerate(self.letter)}
        return [bytes(byte_of[c] for c in w).decode() for w, _ in parts]

    def piece(self, data: bytes) -> bytes:
        """Ids of a text without ASCII white space, as little-endian 32-bit integers."""
        text = data.decode()
        parts = self.special_split.split(text) if self.special_split and "<|" in text else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                for w in self._split(part):
                    ids = self.words.get(w)
                    if ids is None:
                        ids = self.older_words.get(w)
                        if ids is None:
                            ids = array("I", self.word(w)).tobytes()
                        if len(self.words) > self.remembered:
                            self.older_words, self.words = self.words, {}
                        if len(w) <= 64:
                            self.words[w] = ids
                    out.append(ids)
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Ids of UTF-8 ``text`` as little-endian 32-bit integers."""
        parts = text.split()
        out, at = list(map(self.pieces.get, parts)), -1
        if None not in out:
            return b"".join(out)
        while True:
            try:
                at = out.index(None, at + 1)
            except ValueError:
                return b"".join(out)
            p = parts[at]
            ids = self.pieces.get(p) or self.older_pieces.get(p)
            if ids is None:
                ids = self.piece(p)
            if len(self.pieces) > self.remembered:
                self.older_pieces, self.pieces = self.pieces, {}
            if len(p) <= 64:
                self.pieces[p] = ids
            out[at] = ids

    def decode(self, ids: np.ndarray) -> str:
        return self.names.gather(ids)[0][:-1].decode()


@functools.lru_cache(maxsize=4)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    return Encoder(path, remembered)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encode_stage(path: str | None, outputs: tuple[str, ...]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or default_vocabulary())
        for batch, texts in batches(it, 1 << 20):
            coded = [enc.encode(t) for t in texts]
            counts = np.array([len(c) // 4 for c in coded], np.int64)
            ids = np.frombuffer(b"".join(coded), "<u4")
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts)}
            if "ids" in outputs:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(ids.astype(np.int32)))
            if "decoded" in outputs:
                columns["decoded"] = pa.array([s.decode() for s in _pieces(enc.names, ids, counts)], pa.string())
            if "ids_sha256" in outputs:
                columns["ids_sha256"] = pa.array([hashlib.sha256(s).hexdigest() for s in _pieces(enc.decimals, ids, counts)])
            if "decoded_sha256" in outputs:
                columns["decoded_sha256"] = pa.array([hashlib.sha256(s).hexdigest() for s in _pieces(enc.names, ids, counts)])
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _pieces(table: OffsetTable, ids: np.ndarray, counts: np.ndarray) -> Iterator[memoryview]:
    """What ``table`` gives for each document's ids, joined by single spaces."""
    blob, ends = table.gather(ids)
    view, ends = memoryview(blob), np.concatenate([[0], ends])
    cuts = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
    for lo, hi in zip(cuts, cuts[1:]):
        yield view[lo : max(lo, hi - 1)].tobytes()


TYPES = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, vocabulary: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id, n_tokens and ``outputs``: any of ids, decoded (the text decoded from
    the ids), ids_sha256 (of the decimal ids joined by a space), decoded_sha256.

    Null text: no tokens. One output row per input row, whatever repeats.
    """
    bounded_batches(docs.sparkSession)
    outputs = tuple(o for o in TYPES if o in outputs)
    schema = ", ".join(["doc_id long", "n_tokens long", *(f"{o} {TYPES[o]}" for o in outputs)])
    return docs.select("doc_id", "text").mapInArrow(_encode_stage(vocabulary, outputs), schema)
