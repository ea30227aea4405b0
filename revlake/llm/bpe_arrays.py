"""The token ids of many texts at once, on arrays; equal to those of ``bpe.Encoder``.

Texts are cut into pieces at ASCII white space, each distinct piece of a call is looked up
in a bounded table, and the words of those that it lacks go through the merge procedure
side by side: a matrix holds a word a row, and each round makes the first of the merges of
least rank in every row. A row loses one symbol a round, and leaves when no pair merges.

Latin letters are classified and lower-cased by tables of their code points. Other pieces,
such as long ones, apostrophes and special tokens, go to ``bpe.Encoder`` one by one.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from revlake.llm.bpe import SPLIT, Encoder, encoder

#: Bytes beyond which a piece goes to the encoder by itself and is not remembered.
LONG = 64
#: Pieces whose words are merged side by side, and the lengths up to which words share a matrix.
AT_ONCE, WIDTHS = 100_000, (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 24, 32, 48, 64)
#: Kinds of characters; a piece with an odd one goes to the encoder.
OTHER, LETTER, NUMBER, ODD = range(4)
#: The first code point, and the first byte, beyond the Latin letters of two bytes that the tables know.
END_POINT, END_LEAD = 0x240, 0xC9
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower-case code point by code point; 0x7FF stands for all that is not known."""
    kinds, lower = np.full(0x800, ODD, np.uint8), np.arange(0x800, dtype=np.int32)
    for point in range(END_POINT):
        c = chr(point)
        low = c.lower()
        known = c != "'" and unicodedata.normalize("NFC", c) == c and len(low) == 1 and ord(low) < 0x800 and len(low.encode()) == len(c.encode())
        if known and SPLIT.fullmatch(c):  # white space is in no word
            kinds[point] = LETTER if SPLIT.fullmatch("a" + c) else NUMBER if not SPLIT.fullmatch("!" + c) else OTHER
            lower[point] = ord(low)
    return kinds, lower


KINDS, LOWER = _characters()


class PairTable:
    """Ranks of pairs of token ids in an open-addressed table, looked up as arrays."""

    NONE = np.int32(2**31 - 1)
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: list[tuple[int, int]]):
        bits = max(4, (8 * len(pairs)).bit_length() - 1)  # at most a quarter full
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.NONE, np.int32)
        left, (a, b) = np.arange(len(pairs)), np.array(pairs, np.int64).reshape(-1, 2).T
        keys, slots = self._key(a, b)
        while len(left):  # of those that want the same free slot one gets it, the others go on
            free = left[self.ranks[slots[left]] == self.NONE]
            self.keys[slots[free]] = keys[free]
            free = free[self.keys[slots[free]] == keys[free]]
            self.ranks[slots[free]] = free
            left = np.setdiff1d(left, free)
            slots[left] = (slots[left] + 1) & self.last

    def _key(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        return keys, ((keys * self.FACTOR) >> self.shift).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE, which empty slots hold."""
        keys, slots = self._key(a, b)
        out = self.ranks[slots]
        wrong = np.flatnonzero((self.keys[slots] != keys) & (out != self.NONE))
        while len(wrong):
            slots[wrong] = (slots[wrong] + 1) & self.last
            out[wrong] = self.ranks[slots[wrong]]
            wrong = wrong[(self.keys[slots[wrong]] != keys[wrong]) & (out[wrong] != self.NONE)]
        return out


class Lists:
    """Arrays of token ids by number: one flat array, where each starts, and how many it has."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        self.flat, self.starts, self.counts = flat, starts, counts

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lists ``at`` one after another, and where each one ends."""
        n = self.counts[at]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends

    def pick(self, at: np.ndarray) -> Lists:
        flat, ends = self.take(at)
        return Lists(flat, ends - self.counts[at], self.counts[at])

    def __add__(self, more: Lists) -> Lists:
        return Lists(*map(np.concatenate, ((self.flat, more.flat), (self.starts, more.starts + len(self.flat)), (self.counts, more.counts))))


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.BinaryArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes_of(strings: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``strings`` one after another, and their lengths."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64)


NOTHING = Lists(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))


class ArrayEncoder:
    def __init__(self, single: Encoder, remembered: int):
        self.single, self.remembered = single, remembered
        self.ranks = PairTable(list(single.pair))
        self.made = np.array(list(single.pair.values()), np.int32)
        self.letters = np.array([[single.id_of[chr(b + last)] for b in range(256)] for last in (0, 256)], np.int32)
        self.known, self.ids, self.used, self.calls = pa.array([], pa.binary()), NOTHING, np.zeros(0, np.int64), 0

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, with ``end`` behind each text, and how many each has."""
        data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
        inside = ~SPACE[data]
        edges = np.flatnonzero(np.diff(inside, prepend=False))  # the last byte is a space
        begins, lengths = edges[::2], edges[1::2] - edges[::2]
        coded = _strings(data[inside], lengths).dictionary_encode()
        ids, ends = self._distinct(coded.dictionary).take(coded.indices.to_numpy())
        bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        counts = np.diff(np.concatenate([[0], ends])[np.searchsorted(begins, bounds)], prepend=0) + 1
        out = np.full(len(ids) + len(texts), end, "<u4")
        token = np.ones(len(out), bool)
        token[np.cumsum(counts) - 1] = False
        out[token] = ids
        return out, counts

    def _distinct(self, pieces: pa.BinaryArray) -> Lists:
        """The ids of each of ``pieces``, which are distinct; most are remembered."""
        self.calls += 1
        at = pc.index_in(pieces, value_set=self.known)
        lacking = at.is_null()
        new, at = pieces.filter(lacking), at.fill_null(0).to_numpy().astype(np.int64)
        lacking = lacking.to_numpy(zero_copy_only=False)
        self.used[at[~lacking]] = self.calls
        ids = self.ids
        for lo in range(0, len(new), AT_ONCE):
            ids = ids + self._pieces(new.slice(lo, AT_ONCE))
        at[lacking] = len(self.known) + np.arange(len(new))
        found = ids.pick(at)
        short = np.concatenate([np.ones(len(self.known), bool), pc.binary_length(new).to_numpy() <= LONG])
        used = np.concatenate([self.used, np.full(len(new), self.calls)])
        stay = np.flatnonzero(short)
        if len(stay) > self.remembered:  # what was used last stays, up to half the table
            stay = np.sort(stay[np.argsort(-used[stay], kind="stable")[: self.remembered // 2]])
        self.known = pa.concat_arrays([self.known, new])
        if len(stay) < len(short):
            self.known, ids, used = self.known.take(pa.array(stay)), ids.pick(stay), used[stay]
        self.ids, self.used = ids, used
        return found

    def _pieces(self, pieces: pa.BinaryArray) -> Lists:
        """The ids of each piece by the merge procedure."""
        data, lengths = _bytes_of(pieces)
        points = data.astype(np.int32)
        points[data >= 0x80] = 0x7FF
        two = np.flatnonzero((data >= 0xC2) & (data < END_LEAD))
        points[two] = points[two + 1] = (data[two] & 31).astype(np.int32) << 6 | (data[two + 1] & 63)
        kinds = KINDS[points]
        kinds[:-1][(data[:-1] == ord("<")) & (data[1:] == ord("|"))] = ODD  # perhaps a special token
        odd = (np.maximum.reduceat(kinds, np.cumsum(lengths) - lengths) == ODD) | (lengths > LONG)
        low = LOWER[points]
        lowered = np.where(data < 0x80, low, data).astype(np.uint8)
        lowered[two], lowered[two + 1] = 0xC0 | low[two] >> 6, 0x80 | low[two] & 63
        # Words begin with a piece, a number, and where the kind changes.
        begins = (kinds != np.concatenate([[ODD], kinds[:-1]])) | ((kinds == NUMBER) & ((data & 0xC0) != 0x80))
        begins[np.cumsum(lengths) - lengths] = True
        plain = np.repeat(~odd, lengths)
        begins, lowered = begins[plain], lowered[plain]
        places = np.flatnonzero(begins)
        words = _strings(lowered, np.diff(places, append=len(lowered))).dictionary_encode()
        flat, ends = self._words(words.dictionary).take(words.indices.to_numpy())
        # A piece has the ids of its words.
        firsts = np.searchsorted(places, np.concatenate([[0], np.cumsum(lengths[~odd])]))
        bounds = np.concatenate([[0], ends])[firsts]
        single = [np.frombuffer(self.single.piece(p), "<u4").astype(np.int32) for p in pieces.filter(pa.array(odd)).to_pylist()]
        starts, counts = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        starts[~odd], counts[~odd] = bounds[:-1], np.diff(bounds)
        counts[odd] = [len(s) for s in single]
        starts[odd] = len(flat) + np.cumsum(counts[odd]) - counts[odd]
        return Lists(np.concatenate([flat, *single]), starts, counts)

    def _words(self, words: pa.BinaryArray) -> Lists:
        """The ids of each word."""
        data, lengths = _bytes_of(words)
        ends = np.cumsum(lengths)
        symbols = self.letters[0][data]
        symbols[ends - 1] = self.letters[1][data[ends - 1]]
        order = np.argsort(lengths, kind="stable")
        cuts = np.searchsorted(lengths[order], [*WIDTHS, 1 << 62], side="right").tolist()
        rows, flat = [order[:0]], [symbols[:0]]
        counts = np.zeros(len(words), np.int64)
        for lo, hi in zip([0, *cuts], cuts):
            row = order[lo:hi]
            if not len(row):
                continue
            # A word a row, behind its symbols at least one place without any.
            place = np.arange(lengths[row[-1]] + 1)
            full = place < lengths[row][:, None]
            m = np.full(full.shape, -1, np.int32)
            m[full] = symbols[((ends - lengths)[row][:, None] + place)[full]]
            r = np.full(full.shape, PairTable.NONE, np.int32)  # of each symbol and the one behind it
            pairs = full[:, 1:]
            r[:, :-1][pairs] = self.ranks.get(m[:, :-1][pairs], m[:, 1:][pairs])
            while len(row):
                at = r.argmin(axis=1)
                least = r[np.arange(len(row)), at]
                live = least != PairTable.NONE
                if not live.all():
                    ready = m[~live]
                    rows.append(row[~live])
                    counts[row[~live]] = (ready >= 0).sum(axis=1)
                    flat.append(ready[ready >= 0])
                    row, m, r, at, least = row[live], m[live], r[live], at[live], least[live]
                i, (n, width) = np.arange(len(row)), m.shape
                keep = np.ones((n, width), bool)
                keep[i, at + 1] = False
                m = m[keep].reshape(n, width - 1)
                m[i, at] = self.made[least]
                keep[i, at + 1], keep[i, at] = True, False
                r = r[keep].reshape(n, width - 1)
                r[i, at] = self.ranks.get(m[i, at], m[i, at + 1])
                i = np.flatnonzero(at)
                at = at[i] - 1
                r[i, at] = self.ranks.get(m[i, at], m[i, at + 1])
        done = np.concatenate(rows)
        starts = np.empty(len(words), np.int64)
        starts[done] = np.cumsum(counts[done]) - counts[done]
        return Lists(np.concatenate(flat), starts, counts)


@functools.lru_cache(maxsize=4)
def array_encoder(path: str, remembered: int) -> ArrayEncoder:
    return ArrayEncoder(encoder(path), remembered)
