"""Lossless WebP: a decoder of the whole format and an encoder for sample arrays.

Decoding reads prefix codes, literals, back-references and the colour cache, one
or many code groups, and inverts the predictor, cross-colour, subtract-green and
palette transforms; the result is an ARGB pixel array. Literals are decoded in
bulk: a table lookup at every bit place gives the place after the pixel that
would start there, these steps are composed to strides of four pixels, and only
the strides are walked one by one.

Encoding writes a grey image (red = green = blue = sample) with subtract-green,
a palette when there are 16 colours or fewer, length-limited prefix codes, and
back-references at any distance, for runs and for what repeats. It makes no use of the
predictor and cross-colour transforms, the colour cache and several code groups, which
gain nothing on samples of text; the decoder reads them. ``store`` keeps any byte string: 64 samples a row, as
many rows as needed; beyond ``ROWS`` rows another image follows in the same value.

Media are written as Parquet and read again by a second stage, which decodes them and
computes hashes and features from the pixels.

Null or empty text is one row of zeros. Equal texts have equal stored forms, so repeated
rows and rows without an id give what any other does. A text beyond 1 MiB is several
images in one value. An empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revlake.llm.common import batches, bounded_batches, materialise

WIDTH = 64
#: Rows of one image: 1 MiB of samples, and the format's largest height.
ROWS = 16_384
#: Shortest run that is written as a back-reference.
RUN = 12
#: Pixels that repeat further up at least, to be written as a back-reference.
FAR = 24
#: Longest code word that the encoder makes (the format allows 15).
LIMIT = 12

# Fixed values of the format.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)


#: Every 15-bit number with its bits in reverse order.
_REVERSED = np.array([int(f"{k:015b}"[::-1], 2) for k in range(1 << 15)])


def _reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical code words of ``lengths``, first bit lowest, as the stream has them."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[used]
    codes = np.zeros(len(lengths), np.int64)
    if len(used):
        # Left-aligned in 15 bits, each word starts where the shorter ones before it end.
        starts = np.cumsum(1 << (15 - sizes)) - (1 << (15 - sizes))
        codes[used] = _REVERSED[np.minimum(starts, (1 << 15) - 1)] & ((1 << sizes) - 1)
    return codes


class Bits:
    """Bits of a stream, lowest first."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        self.three = padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def read(self, n: int) -> int:
        value = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends too early")
        return value

    def windows(self, lo: int, hi: int, n: int) -> np.ndarray:
        """The next ``n`` bits at every place of lo..hi (whole bytes)."""
        three = self.three[lo >> 3 : hi >> 3]
        return (three[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << n) - 1)).reshape(-1)


class Code:
    """A prefix code as a table over the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:  # one symbol takes no bits
            self.bits, self.only = 0, int(used[0]) if len(used) else 0
            self.symbol, self.length = np.array([self.only], np.int32), np.zeros(1, np.int32)
        else:
            self.bits, self.only = int(lengths.max()), None
            if (1 << self.bits >> lengths[used]).sum() != 1 << self.bits:
                raise ValueError("the code is not complete")
            self.symbol, self.length = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
            codes = _reversed_codes(lengths)
            for s in used.tolist():
                n = int(lengths[s])
                self.symbol[int(codes[s]) :: 1 << n], self.length[int(codes[s]) :: 1 << n] = s, n

    def read(self, bits: Bits) -> int:
        if not self.bits:
            return self.only
        at = bits.at
        window = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << self.bits) - 1)
        symbol, n = self.pairs[window] if self.bits <= 7 else (int(self.symbol[window]), int(self.length[window]))
        bits.at += n
        return symbol

    @functools.cached_property
    def pairs(self) -> list[tuple[int, int]]:
        return list(zip(self.symbol.tolist(), self.length.tolist()))


@functools.lru_cache(maxsize=2048)
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.int64))


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1), *([bits.read(8)] if two else [])]
        lengths[symbols] = 1
        return _code(lengths.tobytes())
    first = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        first[LENGTH_ORDER[k]] = bits.read(3)
    code, left = _code(first.tobytes()), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, before = 0, 8
    while at < size and left:
        left -= 1
        kind = code.read(bits)
        if kind < 16:
            lengths[at], at = kind, at + 1
            before = kind or before
        else:
            n = 3 + bits.read(2) if kind == 16 else 3 + bits.read(3) if kind == 17 else 11 + bits.read(7)
            if at + n > size:
                raise ValueError("too many code lengths")
            lengths[at : at + n] = before if kind == 16 else 0
            at += n
    return Code(lengths)


def _prefixed(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded image as ARGB integers, one after another."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    block, groups, group_of = 0, 1, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        group_of = (_read_image(bits, across, (height + (1 << block) - 1) >> block) >> 8 & 0xFFFF).astype(np.int64)
        groups = int(group_of.max()) + 1
    sizes = [256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    out = np.zeros(total, np.uint32)
    cache = np.zeros(1 << cache_bits, np.uint32) if cache_bits else None
    done = cached = 0

    def remember(upto: int) -> None:
        nonlocal cached
        if cache is not None and cached < upto:
            new = out[cached:upto]
            cache[(new * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)] = new  # of equal places the last stays
        cached = upto

    bulk = _Bulk(bits, codes[0]) if groups == 1 else None
    while done < total:
        if bulk:
            pixels = bulk.literals(total - done)
            out[done : done + len(pixels)] = pixels
            done += len(pixels)
            if done >= total:
                break
            green, red, blue, alpha, distance = codes[0]
        else:
            green, red, blue, alpha, distance = codes[group_of[(done // width >> block) * across + (done % width >> block)]]
        symbol = green.read(bits)
        if symbol < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[done] = a << 24 | r << 16 | symbol << 8 | b
            done += 1
        elif symbol < 280:
            n, far = _prefixed(symbol - 256, bits), _prefixed(distance.read(bits), bits)
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > done or done + n > total:
                raise ValueError("a back-reference leaves the image")
            for at in range(done, done + n, far):  # what it repeats may be its own beginning
                k = min(far, done + n - at)
                out[at : at + k] = out[at - far : at - far + k]
            done += n
        else:
            remember(done)
            out[done] = cache[symbol - 280]
            done += 1
        if bits.at > bits.end:
            raise ValueError("the stream ends too early")
    return out


class _Bulk:
    """Runs of literal pixels under one group of codes."""

    SPAN = 1 << 18  # bits looked up at once

    def __init__(self, bits: Bits, codes: list[Code]):
        self.bits, self.codes, self.lo, self.hi = bits, codes, 0, 0

    def _look(self, at: int) -> None:
        bits = self.bits
        self.lo = at & ~7
        self.hi = min(self.lo + self.SPAN, (bits.end + 7) & ~7)
        end = min(self.hi + 64, 8 * len(bits.three))
        green = self.codes[GREEN]
        n = self.hi - self.lo
        places = np.arange(end - self.lo, dtype=np.int32)
        last = len(places) - 1
        window = bits.windows(self.lo, end, green.bits)
        symbol, step = green.symbol[window], places + green.length[window]
        pixel = symbol.astype(np.uint32) << np.uint32(8)
        for code, shift in ((self.codes[RED], 16), (self.codes[BLUE], 0), (self.codes[ALPHA], 24)):
            if code.bits:
                step = np.minimum(step, last)
                window = bits.windows(self.lo, end, code.bits)[step]
                pixel |= code.symbol[window].astype(np.uint32) << np.uint32(shift)
                step = step + code.length[window]
            else:
                pixel |= np.uint32(code.only << shift)
        step = step[:n]
        places = places[:n]
        # A place stops where the pixel is no literal or ends outside of what is looked up.
        step = np.where((symbol[:n] >= 256) | (step >= n), places, step)
        two = step[step]
        self.pixel, self.step, self.two, self.four = pixel[:n], step, two, two[two]
        self.jump = memoryview(self.four)

    def literals(self, most: int) -> np.ndarray:
        bits, parts, got = self.bits, [], 0
        if not self.codes[GREEN].bits and self.codes[GREEN].only < 256 and not any(c.bits for c in self.codes[1:4]):
            r, b, a = (c.only for c in self.codes[1:4])
            return np.full(most, a << 24 | r << 16 | self.codes[GREEN].only << 8 | b, np.uint32)
        while got < most and bits.at < bits.end:
            if not self.lo <= bits.at < self.hi:
                self._look(bits.at)
            at, jump, strides = bits.at - self.lo, self.jump, []
            add = strides.append
            for _ in range((most - got) // 4 + 1):
                add(at)
                to = jump[at]
                if to == at:
                    break
                at = to
            at = np.array(strides)
            every = np.stack([at, self.step[at], self.two[at], self.step[self.two[at]]], axis=1).reshape(-1)
            moved = every[self.step[every] != every]  # the place that stops repeats; it is no literal
            moved = moved[: most - got]
            parts.append(self.pixel[moved])
            got += len(moved)
            if len(moved):
                bits.at = self.lo + int(self.step[moved[-1]])
            elif self.hi - bits.at < 64 and self.lo != bits.at & ~7 and self.hi < bits.end:
                self._look(bits.at)
            else:
                break
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _average(a, b):
    return (a.astype(np.int32) + b) >> 1


def _predict(mode: int, left, top, right, corner):
    """The prediction of one pixel (four channels) in each of the 14 modes."""
    if mode == 0:
        return np.array([255, 0, 0, 0], np.int32)
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7, 8, 9):
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return _average(a, b)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        to_left, to_top = np.abs(top - corner).sum(), np.abs(left - corner).sum()
        return left if to_left < to_top else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        return np.clip(mean + ((mean - corner) / 2).astype(np.int32), 0, 255)
    return np.array([255, 0, 0, 0], np.int32)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _packed(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predictor(argb: np.ndarray, bits: int, modes: np.ndarray, forward: bool = False) -> np.ndarray:
    """Add the predictions to residuals, or subtract them from pixels (``forward``)."""
    height, width = argb.shape
    given = _channels(argb)
    out = given.copy()
    pixels = given if forward else out
    kinds = modes >> 8 & 15
    for y in range(height):
        row, above = pixels[y], pixels[y - 1]
        for x in range(width):
            if y == 0:
                guess = np.array([255, 0, 0, 0], np.int32) if x == 0 else row[x - 1]
            elif x == 0:
                guess = above[0]
            else:
                right = above[x + 1] if x + 1 < width else row[0]
                guess = _predict(int(kinds[y >> bits, x >> bits]), row[x - 1], above[x], right, above[x - 1])
            out[y, x] = (given[y, x] - guess if forward else given[y, x] + guess) & 255
    return _packed(out)


def _signed(a: np.ndarray) -> np.ndarray:
    return ((a & 255) ^ 128) - 128


def _cross_colour(argb: np.ndarray, bits: int, elements: np.ndarray, forward: bool = False) -> np.ndarray:
    height, width = argb.shape
    c = _channels(argb)
    e = _signed(_channels(elements)).repeat(1 << bits, 0).repeat(1 << bits, 1)[:height, :width]
    green, red, blue = _signed(c[..., 2]), c[..., 1], c[..., 3]
    of_green = e[..., 3] * green >> 5
    new = red - of_green if forward else red + of_green
    shift = (e[..., 2] * green >> 5) + (e[..., 1] * _signed(red if forward else new) >> 5)
    c[..., 1], c[..., 3] = new & 255, (blue - shift if forward else blue + shift) & 255
    return _packed(c)


def _subtract_green(argb: np.ndarray, forward: bool = False) -> np.ndarray:
    green = argb >> 8 & 255
    if forward:
        green = 256 - green
    return argb & 0xFF00FF00 | (argb >> 16) + green << 16 & 0xFF0000 | argb + green & 0xFF


def decode_vp8l(data: bytes) -> np.ndarray:
    """The ARGB pixels, height x width, of one VP8L stream."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in {k for k, *_ in undo}:
            raise ValueError("a transform repeats")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            w, h = (across + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size
            undo.append((kind, across, size, _read_image(bits, w, h).reshape(h, w)))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, across))
        else:
            n = bits.read(8) + 1
            deltas = _channels(_read_image(bits, n, 1))
            colours = _packed(np.cumsum(deltas, axis=0) & 255)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, across, pack, np.concatenate([colours, np.zeros(256 - n, np.uint32)])))
            across = (across + (1 << pack) - 1) >> pack
    argb = _read_image(bits, across, height, True).reshape(height, across)
    for kind, w, *more in reversed(undo):
        if kind == PREDICTOR:
            argb = _predictor(argb, *more)
        elif kind == CROSS_COLOUR:
            argb = _cross_colour(argb, *more)
        elif kind == SUBTRACT_GREEN:
            argb = _subtract_green(argb)
        else:
            pack, colours = more
            index = argb >> 8 & 255
            if pack:
                each = 8 >> pack
                index = (index[..., None] >> (np.arange(1 << pack, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :w]
            argb = colours[index]
    return argb


def chunks(data: bytes) -> Iterator[bytes]:
    """VP8L streams of one WebP file or several that follow one another."""
    at = 0
    while at < len(data):
        riff, size, webp = struct.unpack_from("<4sI4s", data, at)
        if riff != b"RIFF" or webp != b"WEBP":
            raise ValueError("not a WebP file")
        inner, end = at + 12, at + 8 + size
        while inner + 8 <= end:
            name, n = struct.unpack_from("<4sI", data, inner)
            if name == b"VP8L":
                yield data[inner + 8 : inner + 8 + n]
            inner += 8 + n + (n & 1)
        at = end + (size & 1)


def decode(data: bytes) -> list[np.ndarray]:
    """The pixel array of every image in ``data``."""
    return [decode_vp8l(c) for c in chunks(data)]


def wrap(stream: bytes) -> bytes:
    padded = stream + b"\0" * (len(stream) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(padded), b"WEBP", b"VP8L", len(stream)) + padded


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code, of at most ``limit`` bits by flattening the counts."""
    lengths, used = np.zeros(len(counts), np.int64), np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, n = [0] * (2 * len(used)), len(used)
        while len(heap) > 1:
            a, x = heapq.heappop(heap)
            b, y = heap[0]
            parent[x] = parent[y] = n
            heapq.heapreplace(heap, (a + b, n))
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(used)]) <= limit:
            lengths[used] = depth[: len(used)]
            return lengths
        weights = [w // 2 + 1 for w in weights]


class Writer:
    """Fields of some bits each, kept as two lists until they are packed at once."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self._v: list[int] = []
        self._n: list[int] = []

    def put(self, value: int, n: int) -> None:
        self._v.append(value)
        self._n.append(n)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        self.values.append(values.astype(np.uint64))
        self.sizes.append(sizes.astype(np.int64))

    def _flush(self) -> None:
        if self._v:
            self.values.append(np.array(self._v, np.uint64))
            self.sizes.append(np.array(self._n, np.int64))
            self._v, self._n = [], []

    def bytes(self) -> bytes:
        self._flush()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        used = sizes > 0
        values, sizes = values[used], sizes[used]
        ends = np.cumsum(sizes)
        at = ends - sizes
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.bitwise_or.reduceat(values << shift, starts)
        over = np.flatnonzero((at & 63) + sizes > 64)  # one field at most crosses into each next word
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return out.astype("<u8").tobytes()[: (int(ends[-1]) + 7) >> 3]


def write_code(w: Writer, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a prefix code; its code words and their lengths (zero for a lone symbol)."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        w.put(1, 1)
        w.put(0, 1)
        symbol = int(used[0]) if len(used) else 0
        w.put(1, 1)
        w.put(symbol, 8)
        return np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    w.put(0, 1)
    tokens, at, all_ = [], 0, lengths.tolist()
    while at < len(all_):
        n = 1
        while at + n < len(all_) and all_[at + n] == all_[at]:
            n += 1
        if all_[at] == 0 and n >= 3:
            n = min(n, 138)
            tokens.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
            at += n
        else:
            tokens.append((all_[at], 0, 0))
            at += 1
    counts = np.bincount([t for t, *_ in tokens], minlength=19)
    first = code_lengths(counts, 7)
    most = max(k for k in range(19) if first[LENGTH_ORDER[k]]) + 1
    w.put(max(most, 4) - 4, 4)
    for k in range(max(most, 4)):
        w.put(int(first[LENGTH_ORDER[k]]), 3)
    w.put(0, 1)
    codes = _reversed_codes(first)
    sizes = first if np.count_nonzero(first) > 1 else np.zeros_like(first)
    for kind, extra, n in tokens:
        w.put(int(codes[kind]), int(sizes[kind]))
        if n:
            w.put(extra, n)
    return _reversed_codes(lengths), lengths if len(used) > 1 else np.zeros_like(lengths)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, extra value and extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    extra = v.bit_length() - 2
    return 2 * extra + 2 + (v >> extra & 1), v & ((1 << extra) - 1), extra


def _repeats(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references (place, length, distance), in order and apart: runs of one pixel, and
    what stands ``FAR`` pixels or more alike further up, found by sorting hashes of windows."""
    n = len(argb)
    out: list[tuple[int, int, int]] = []
    if n > 2 * FAR:
        powers, back = _powers(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((argb.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)])
        hashed = (sums[FAR:] - sums[:-FAR]) * back[: n - FAR + 1]
        ordered = np.sort(hashed)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        before = np.full(n, -1, np.int64)
        if len(twice):  # only windows that occur again are put in order
            near = np.searchsorted(twice, hashed)
            some = np.flatnonzero(twice[np.minimum(near, len(twice) - 1)] == hashed)
            order = some[np.argsort(hashed[some], kind="stable")]
            same = np.flatnonzero(hashed[order[1:]] == hashed[order[:-1]])
            before[order[same + 1]] = order[same]
        at = 0
        for place in np.flatnonzero(before >= 0).tolist():
            if place < at:
                continue
            source, length = int(before[place]), 0
            while place + length < n:  # how far both go on alike
                step = min(4096, n - place - length)
                differ = np.flatnonzero(argb[place + length : place + length + step] != argb[source + length : source + length + step])
                length += int(differ[0]) if len(differ) else step
                if len(differ):
                    break
            if length >= FAR:
                out.append((place, length, place - source))
                at = place + length
    taken = np.zeros(n, bool)
    for place, length, _ in out:
        taken[place : place + length] = True
    same = np.concatenate([[False], (argb[1:] == argb[:-1])]) & ~taken
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    out += [(lo, hi - lo, 1) for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()) if hi - lo >= RUN]
    return sorted((place + at, min(4096, length - at), far) for place, length, far in out for at in range(0, length, 4096))


_power_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse, ``n`` at least."""
    if not _power_tables or len(_power_tables[0]) < n:
        step = 0xD6E8FEB86659FD93
        _power_tables[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]), dtype=np.uint64) for base in (step, pow(step, -1, 2**64))]
    return _power_tables[0], _power_tables[1]


def write_samples(w: Writer, argb: np.ndarray, runs: bool = True, main: bool = True) -> None:
    """An entropy-coded image: literals, and back-references to what stands before."""
    w.put(0, 1)
    if main:
        w.put(0, 1)
    n = len(argb)
    lengths, literal = np.zeros(n, np.int64), np.ones(n, bool)
    found = _repeats(argb) if runs else []
    for place, length, _ in found:
        lengths[place] = length
        literal[place : place + length] = False
    kept = np.flatnonzero(literal | (lengths > 0))
    green = (argb >> 8 & 255).astype(np.int64)[kept]
    back = np.flatnonzero(lengths[kept])
    extras = [prefix_of(length) for _, length, _ in found]
    # Distance 1 is the second of the near places; others are told plainly, above these.
    ways = [prefix_of(2 if far == 1 else far + 120) for _, _, far in found]
    green[back] = [256 + s for s, _, _ in extras]
    isliteral = lengths[kept] == 0
    gcode, glen = write_code(w, code_lengths(np.bincount(green, minlength=280)))
    values, sizes = gcode[green].astype(np.uint64), glen[green]
    others = argb & np.uint32(0xFF00FFFF)
    for shift in (16, 0, 24):
        if (others == others[0]).all():  # a lone symbol takes no bits
            only = np.zeros(256, np.int64)
            only[int(argb[0]) >> shift & 255] = 1
            write_code(w, only)
            continue
        p = (argb >> shift & 255).astype(np.int64)[kept]
        code, length = write_code(w, code_lengths(np.bincount(p[isliteral], minlength=256)))
        v, s = np.where(isliteral, code[p], 0).astype(np.uint64), np.where(isliteral, length[p], 0)
        values |= v << sizes.astype(np.uint64)
        sizes = sizes + s
    dcode, dlen = write_code(w, code_lengths(np.bincount([s for s, _, _ in ways] or [1], minlength=40)))
    if not found:
        w.extend(values, sizes)
        return
    # A back-reference is two fields: length with its extra bits, distance with its own.
    second, second_bits = np.zeros(len(values), np.uint64), np.zeros(len(values), np.int64)
    for k, (_, extra, size), (symbol, more, wide) in zip(back.tolist(), extras, ways):
        values[k] |= np.uint64(extra) << np.uint64(sizes[k])
        sizes[k] += size
        second[k] = int(dcode[symbol]) | more << int(dlen[symbol])
        second_bits[k] = int(dlen[symbol]) + wide
    fields, bits = np.stack([values, second], axis=1).reshape(-1), np.stack([sizes, second_bits], axis=1).reshape(-1)
    w.extend(fields, bits)


def encode_samples(samples: np.ndarray) -> bytes:
    """A WebP file of a height x width array of 8-bit samples, as a grey image."""
    height, width = samples.shape
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    colours = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256))
    if len(colours) <= 16:
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(colours) - 1, 8)
        grey = np.diff(colours, prepend=0).astype(np.uint32)
        alpha = np.concatenate([[255], np.zeros(len(colours) - 1)]).astype(np.uint32)
        write_samples(w, alpha << 24 | grey << 16 | grey << 8 | grey, runs=False, main=False)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        index = np.searchsorted(colours, samples).astype(np.uint32)
        count, each = 1 << pack, 8 >> pack
        index = np.pad(index, ((0, 0), (0, -width % count))).reshape(height, -1, count)
        argb = (index << (np.arange(count, dtype=np.uint32) * each)).sum(axis=2).astype(np.uint32) << 8 | 0xFF000000
    else:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        argb = samples.astype(np.uint32) << 8 | 0xFF000000
    w.put(0, 1)
    write_samples(w, argb.reshape(-1).astype(np.uint32))
    return wrap(w.bytes())


def store(payload: bytes) -> bytes:
    """``payload`` (a positive multiple of 64 bytes) as WebP images of 64 samples a row."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(encode_samples(samples[at : at + ROWS]) for at in range(0, len(samples), ROWS))


def load(media: bytes) -> bytes:
    """What ``store`` stored."""
    return b"".join((a >> 8).astype(np.uint8).tobytes() for a in decode(media))


def features(payload: bytes) -> str:
    """Size, range, sum, distinct samples and horizontal contrast of the pixel array."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    counts = np.bincount(a.reshape(-1), minlength=256)
    contrast = int(np.abs(np.diff(a.astype(np.int16), axis=1)).sum(dtype=np.int64))
    return f"{WIDTH}x{len(a)} min={int(counts.argmax() if counts.max() == a.size else np.flatnonzero(counts)[0])} max={int(np.flatnonzero(counts)[-1])} sum={int((counts * np.arange(256)).sum())} distinct={int((counts > 0).sum())} contrast={contrast}"


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def _store_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in batches(it):
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array([store(payload_of(t)) for t in texts], pa.binary())})


def _load_stage(with_media: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for value in batch.column("media"):
                media = value.as_py()
                back = load(media)
                for k, v in (("payload_bytes", len(back)), ("payload_sha256", hashlib.sha256(back).hexdigest()), ("tail_crc32", zlib.crc32(back[-64:])), ("media_bytes", len(media)), ("media_sha256", hashlib.sha256(media).hexdigest()), ("feature", features(back))):
                    rows[k].append(v)
            kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string()}
            columns = {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), **{k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()}}
            yield pa.RecordBatch.from_pydict(columns | ({"media": batch.column("media")} if with_media else {}))

    return run


def store_texts(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """doc_id, sizes, hashes and features of every text's stored form, as read back from where it was written, and the form itself."""
    bounded_batches(docs.sparkSession)
    written = materialise(docs.select("doc_id", "text").mapInArrow(_store_stage, f"doc_id {docs.select('doc_id').dtypes[0][1]}, n_bytes long, media binary"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return written.mapInArrow(_load_stage(with_media), schema)


def _pixel_stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for key, media in zip(batch.column(0), batch.column(1)):
            for image, argb in enumerate(decode(media.as_py()) if media.is_valid else []):
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), pa.array([image], pa.int32()), pa.array([argb.shape[1]], pa.int32()), pa.array([argb.shape[0]], pa.int32()), pa.array([_channels(argb).astype(np.uint8).tobytes()], pa.binary())], names=["id", "image", "width", "height", "argb"])


def decode_media(frame: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """id, image number, width, height and the raw ARGB bytes of every stored image; null media have none."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    frame = frame.select(key, media)
    return frame.mapInArrow(_pixel_stage, f"id {frame.dtypes[0][1]}, image int, width int, height int, argb binary")
