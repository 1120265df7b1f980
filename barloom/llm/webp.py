"""Lossless WebP: a whole decoder, an encoder, and texts as pixels (operator 2).

The decoder reads any still VP8L stream: simple and normal prefix codes, groups of them,
back-references, the colour cache, and the predictor, cross-colour, subtract-green and
palette transforms; it returns pixel arrays. An image with one group of codes is decoded in
numpy: every bit position is looked up in the prefix tables at once, one walk along the
positions picks those where pixels begin, and references and cache hits are pointers to
earlier pixels, followed by doubling. Images with several groups go pixel by pixel.

``compress`` writes what the query stores: of no transform, a predictor, cross-colour and a
palette the one with the least entropy, back-references to the last place where three pixels
stood, a colour cache where it is hit often enough, and canonical prefix codes. Most documents
are short, so ``write_all`` codes the strips of many side by side, ``TOGETHER`` pixels at a
time: each file has its own codes and is the same as if it were written alone.

``store`` turns a text into media and reads it back: UTF-8, blanks up to a positive
multiple of 192 bytes, 64 RGB pixels to a row, strips of at most ``STRIP_ROWS`` rows, each a
WebP file; the files follow one another (each names its own size).

Defined cases: a null text counts as empty, and an empty text is one row of blanks; texts of
any length become more strips; equal texts give equal bytes; a null doc_id is passed on.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import Counter
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices, texts

ROW, WIDTH, STRIP_ROWS = 192, 64, 256
TOGETHER = 1 << 14

# fixed values of the format
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
_CACHE_FACTOR = 0x1E35A7BD
# pixels are arrays (..., 4) of uint8 in the order alpha, red, green, blue
A, R, G, B = range(4)


class Bits:
    """Little-endian bit reader."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        byte, shift = divmod(self.at, 8)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends too early")
        return int.from_bytes(self.data[byte : byte + (shift + n + 7) // 8], "little") >> shift & ((1 << n) - 1)

    def ahead(self, n: int) -> np.ndarray:
        """At most n of the bits that follow, as an array, without moving on."""
        byte, shift = divmod(self.at, 8)
        n = min(n, 8 * len(self.data) - self.at)
        raw = np.frombuffer(self.data, np.uint8, (shift + n + 7) // 8, byte)
        return np.unpackbits(raw, bitorder="little")[shift : shift + n]


_REVERSED: list[np.ndarray] = [np.zeros(1, np.int64)]


def reversed_bits(width: int) -> np.ndarray:
    """All numbers of ``width`` bits, each read backwards."""
    while len(_REVERSED) <= width:
        _REVERSED.append(np.concatenate((2 * _REVERSED[-1], 2 * _REVERSED[-1] + 1)))
    return _REVERSED[width]


def sixteen(stream: np.ndarray, more: int) -> np.ndarray:
    """The 16 bits from each position of a stream of bits, and of ``more`` positions past it."""
    out = np.zeros(len(stream) + more, np.uint16)
    out[: len(stream)] = stream
    for step in (1, 2, 4, 8):
        out[:-step] |= out[step:] << np.uint16(step)
    return out


class Prefix:
    """A canonical prefix code. ``only``: its one symbol, read without bits."""

    def __init__(self, lengths: np.ndarray, used: np.ndarray | None = None):
        """lengths: of every symbol, or with ``used`` of these, in rising order."""
        if used is None:
            used = np.flatnonzero(lengths)
            lengths = lengths[used]
        if not len(used):
            used, lengths = np.zeros(1, np.int64), np.zeros(1, np.int64)
        order = lengths.astype(np.uint8).argsort(kind="stable")
        self.symbols, self.lengths = used[order], lengths[order]
        self.only = int(self.symbols[0]) if len(used) == 1 else None
        if self.only is None and int((1 << (15 - self.lengths.astype(np.int64))).sum()) != 1 << 15:
            raise ValueError("code lengths do not fill the code space")
        self.width = 0 if self.only is not None else int(self.lengths[-1])

    def tables(self) -> np.ndarray:
        """16 times the symbol plus the code length, for each value of the next ``width`` bits."""
        if self.only is not None:
            return self.symbols[:1].astype(np.int32) << 4
        entry = self.symbols.astype(np.int32) << 4 | self.lengths.astype(np.int32)
        return np.repeat(entry, 1 << (self.width - self.lengths))[reversed_bits(self.width)]


_OUTER: dict[tuple[int, int], tuple[list[tuple[int, int, int, int]], int]] = {}  # codes of code lengths: files of one writer share few
_BEFORE = 16  # stands for the length before


def _outer(n: int, three: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """For each value of the next bits how many it takes, a length, of how many symbols, and how many bits more say so; a mask of those bits."""
    outer = np.zeros(19, np.int64)
    for k, i in enumerate(LENGTH_ORDER[:n]):
        outer[i] = three >> 3 * k & 7
    code = Prefix(outer)
    runs = {16: (_BEFORE, 3, 2), 17: (0, 3, 3), 18: (0, 11, 7)}
    return [(entry & 15, *runs.get(entry >> 4, (entry >> 4, 1, 0))) for entry in code.tables().tolist()], (1 << code.width) - 1


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    if bits.read(1):
        kind = bits.read(2)
        used = [bits.read(8 if kind & 2 else 1)]
        if kind & 1:
            used = sorted({used[0], bits.read(8)})
        return Prefix(np.ones(len(used), np.int64), np.array(used))
    n = 4 + bits.read(4)
    known = n, bits.read(3 * n)
    if known not in _OUTER:
        if len(_OUTER) > 64:
            _OUTER.clear()
        _OUTER[known] = _outer(*known)
    table, mask = _OUTER[known]
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    byte, shift = divmod(bits.at, 8)
    ahead = int.from_bytes(bits.data[byte : byte + (shift + 14 * left + 7) // 8], "little") >> shift
    used, lengths = [], []
    at, before, past = 0, 8, bits.at
    while at < alphabet and left:
        left -= 1
        taken, length, many, more = table[ahead & mask]
        if more:
            many += ahead >> taken & ((1 << more) - 1)
            taken += more
        ahead >>= taken
        past += taken
        if length == _BEFORE:
            used += range(at, at + many)
            lengths += [before] * many
        elif length:
            used.append(at)
            lengths.append(length)
            before = length
        at += many
    if past > 8 * len(bits.data):
        raise ValueError("the stream ends too early")
    bits.at = past
    if at > alphabet:
        raise ValueError("a repeat runs past the alphabet")
    return Prefix(np.array(lengths, np.int64), np.array(used, np.int64))


_NEAR_STEPS: dict[int, np.ndarray] = {}  # by width: how far back each short distance code is


def near_steps(width: int) -> np.ndarray:
    if width not in _NEAR_STEPS:
        if len(_NEAR_STEPS) > 64:
            _NEAR_STEPS.clear()
        _NEAR_STEPS[width] = np.array([max(1, dx + dy * width) for dx, dy in NEAR])
    return _NEAR_STEPS[width]


def read_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Entropy-coded pixels, (height, width, 4); ``top``: the main image, which may have groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    group_of, shift = None, 0
    if top and bits.read(1):
        shift = bits.read(3) + 2
        small = read_image(bits, -(-width >> shift), -(-height >> shift), False)
        group_of = small[..., R].astype(np.int64) << 8 | small[..., G]
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_prefix(bits, n) for n in sizes] for _ in range(1 if group_of is None else int(group_of.max()) + 1)]
    n = width * height
    if group_of is None:
        return _read_pixels(bits, groups[0], n, width, cache_bits).astype(">u4").view(np.uint8).reshape(height, width, 4)
    stream = bits.ahead(n * max(max(sum(c.width for c in g[:4]), g[0].width + g[4].width + 28) for g in groups))
    ahead = sixteen(stream, 160).data  # a pixel reaches so far past its beginning at most
    tables = [[(c.tables().data, (1 << c.width) - 1) for c in g] for g in groups]
    near = [max(1, dx + dy * width) for dx, dy in NEAR]
    out = [0] * n
    cache = [0] * (1 << cache_bits)
    cached = at = p = 0

    def look(k: int) -> int:
        nonlocal p
        table, mask = codes[k]
        entry = table[ahead[p] & mask]
        p += entry & 15
        return entry >> 4

    def number(symbol: int) -> int:
        nonlocal p
        if symbol < 4:
            return symbol + 1
        more = (symbol - 2) >> 1
        value = (ahead[p] | ahead[p + 16] << 16) & ((1 << more) - 1)
        p += more
        return ((2 + (symbol & 1)) << more) + value + 1

    while at < n:
        if p > len(stream):
            raise ValueError("the stream ends too early")
        y, x = divmod(at, width)
        codes = tables[group_of[y >> shift, x >> shift]]
        symbol = look(0)
        if symbol < 256:
            red, blue, alpha = look(1), look(2), look(3)
            out[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < 280:
            length = number(symbol - 256)
            code = number(look(4))
            distance = code - 120 if code > 120 else near[code - 1]
            if distance > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out[at] = out[at - distance]
                at += 1
        else:
            for pixel in out[cached:at]:
                cache[(_CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel
            cached = at
            out[at] = cache[symbol - 280]
            at += 1
    if p > len(stream):
        raise ValueError("the stream ends too early")
    bits.at += p
    return np.array(out, ">u4").view(np.uint8).reshape(height, width, 4)


def _read_pixels(bits: Bits, codes: list[Prefix], n: int, width: int, cache_bits: int) -> np.ndarray:
    """The next n pixels as numbers."""
    green, red, blue, alpha, far = (c.tables() for c in codes)
    g_mask, r_mask, b_mask, a_mask, d_mask = (np.uint16((1 << c.width) - 1) for c in codes)
    tail = 64  # a code and what follows it may reach so far past its beginning
    stream = bits.ahead(n * max(sum(c.width for c in codes[:4]), codes[0].width + codes[4].width + 28))
    size = len(stream)
    next_bits = sixteen(stream, 2 * tail)
    entry = green.take(next_bits[: size + 1] & g_mask)
    after_green = (entry & 15) + np.arange(size + 1, dtype=np.int32)
    after_red = after_green + (red & 15).take(next_bits.take(after_green) & r_mask)
    after_blue = after_red + (blue & 15).take(next_bits.take(after_red) & b_mask)
    following = after_blue + (alpha & 15).take(next_bits.take(after_blue) & a_mask) if codes[3].width else after_blue  # where a pixel of the cache or a reference stands, nothing else is read of it
    pixels = np.ones(size + 1, np.int32)
    other = codes[0].symbols.max() >= 256
    if other:
        at = np.flatnonzero(entry >= 280 << 4)
        following[at] = after_green[at]
        at = np.flatnonzero((entry >= 256 << 4) & (entry < 280 << 4))
        length, place = _number_at(next_bits, after_green[at], (entry[at] >> 4) - 256)
        index = far[next_bits[place] & d_mask]
        code, place = _number_at(next_bits, place + (index & 15), index >> 4)
        following[at], pixels[at] = place, length
        distance = np.zeros(size + 1, np.int64)
        distance[at] = code
    starts, p = [], 0
    follow, add = following.data, starts.append
    with suppress(IndexError):  # past the end of the stream
        for _ in range(n):
            add(p)
            p = follow[p]
    if p > size:
        starts.pop()
    at = np.array(starts, np.int64)
    many = pixels[at].astype(np.int64)
    done = np.cumsum(many)
    last = int(np.searchsorted(done, n))  # references take several pixels: what comes after the last one is no part of the image
    if last == len(at) or following[at[last]] > size:
        raise ValueError("the stream ends too early")
    at, many, done = at[: last + 1], many[: last + 1], done[: last + 1]
    bits.at += int(following[at[-1]])
    symbol = entry[at].astype(np.int64) >> 4
    first = done - many
    plain = symbol < 256
    q = at[plain]
    out = np.zeros(n, np.int64)
    colour = symbol[plain] << 8
    for code, after, mask, shift in ((alpha, after_blue, a_mask, 24), (red, after_green, r_mask, 16), (blue, after_red, b_mask, 0)):
        colour |= (code[next_bits[after[q]] & mask].astype(np.int64) >> 4 if len(code) > 1 else int(code[0]) >> 4) << shift
    out[first[plain]] = colour
    if not other:
        return out.astype(np.uint32)
    source = np.arange(n)
    copied = np.flatnonzero((symbol >= 256) & (symbol < 280))
    if len(copied):
        code, length, to = distance[at[copied]], many[copied], first[copied]
        near = near_steps(width)
        back = np.where(code > 120, code - 120, near[np.minimum(code, 120) - 1])
        if (back > to).any() or int(to[-1] + length[-1]) > n:
            raise ValueError("a back-reference leaves the image")
        own = np.repeat(to - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        source[own] = own - np.repeat(back, length)
        source = _follow(source)
    cached = symbol >= 280
    if cached.any():
        # a pixel's place in the cache is known without its colour; a hit has the colour of the last pixel before it with that place
        place = _cache_place(out.astype(np.uint64), cache_bits)
        place[first[cached]] = symbol[cached] - 280
        place = place[source].astype(np.uint16)
        order = np.argsort(place, kind="stable")
        last = np.full(n, -1)
        same = place[order[1:]] == place[order[:-1]]
        last[order[1:][same]] = order[:-1][same]
        hits = first[cached]
        empty = hits[last[hits] < 0]
        source[hits] = np.maximum(last[hits], 0)
        source[empty] = empty
        source = _follow(source)
    return out[source].astype(np.uint32)


def _number_at(next_bits: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distance codes whose extra bits begin at ``at``, and where those end."""
    more = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    at = np.minimum(at, len(next_bits) - 32)
    wide = next_bits[at].astype(np.int64) | next_bits[at + 16].astype(np.int64) << 16
    return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << more) + (wide & ((1 << more) - 1))) + 1, at + more


def _follow(source: np.ndarray) -> np.ndarray:
    """Where chains of pointers end."""
    while True:
        further = source[source]
        if (further == source).all():
            return source
        source = further


def _cache_place(colour: np.ndarray, bits: int) -> np.ndarray:
    return ((colour * np.uint64(_CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predict(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One of the 14 predictors; neighbours are arrays (..., 4) of int: L, T, TL, TR."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _half(_half(left, right), top)
    if mode == 6:
        return _half(left, corner)
    if mode == 7:
        return _half(left, top)
    if mode == 8:
        return _half(corner, top)
    if mode == 9:
        return _half(top, right)
    if mode == 10:
        return _half(_half(left, corner), _half(top, right))
    if mode == 11:
        to_left, to_top = abs(top - corner).sum(-1, keepdims=True), abs(left - corner).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _half(left, top)
        half = mean - corner
        return np.clip(mean + (half + (half < 0)) // 2, 0, 255)  # rounds towards zero
    return np.broadcast_to(np.array([255, 0, 0, 0]), left.shape)


_FROM_LEFT = {1, 5, 6, 7, 10, 11, 12, 13}


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Add predictions back, row by row: modes that look left go pixel by pixel, the others a block at once."""
    height, width, _ = pixels.shape
    out = pixels.astype(np.int64)
    out[0, 0] = (out[0, 0] + [255, 0, 0, 0]) & 255
    if modes.min() == modes.max() in (1, 2):  # sums along rows and columns
        if modes[0, 0] == 1:
            out[:, 0] = np.cumsum(out[:, 0], axis=0)
            return (np.cumsum(out, axis=1) & 255).astype(np.uint8)
        out[0] = np.cumsum(out[0], axis=0)
        return (np.cumsum(out, axis=0) & 255).astype(np.uint8)
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        above, row = out[y - 1], out[y]
        row[0] = (row[0] + above[0]) & 255
        for block in range(modes.shape[1]):
            lo, hi = max(1, block << shift), min(width, (block + 1) << shift)
            if lo >= hi:
                continue
            mode = int(modes[y >> shift, block])
            right = above[lo + 1 : hi + 1]
            if hi == width:  # right of the last pixel comes the first one of this row
                right = np.concatenate((right, row[:1]))
            if mode == 1:
                row[lo:hi] = (np.cumsum(row[lo:hi], axis=0) + row[lo - 1]) & 255
            elif mode in _FROM_LEFT:
                for x in range(lo, hi):
                    row[x] = (row[x] + predict(mode, row[x - 1], above[x], above[x - 1], right[x - lo])) & 255
            else:
                row[lo:hi] = (row[lo:hi] + predict(mode, above[lo:hi], above[lo:hi], above[lo - 1 : hi - 1], right)) & 255
    return out.astype(np.uint8)


def _delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (factor.astype(np.int8).astype(np.int64) * colour.astype(np.int8).astype(np.int64)) >> 5


def cross_colour(pixels: np.ndarray, elements: np.ndarray, shift: int, sign: int) -> np.ndarray:
    """Undo (sign 1) or apply (sign -1) the cross-colour transform."""
    height, width, _ = pixels.shape
    e = elements[np.arange(height)[:, None] >> shift, np.arange(width)[None, :] >> shift]
    out = pixels.copy()
    red = pixels[..., R] + sign * _delta(e[..., B], pixels[..., G])
    out[..., R] = red & 255
    plain = out[..., R] if sign > 0 else pixels[..., R]
    out[..., B] = (pixels[..., B] + sign * (_delta(e[..., G], pixels[..., G]) + _delta(e[..., R], plain))) & 255
    return out


def bundle_shift(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    shift = bundle_shift(len(table))
    x = np.arange(width)
    depth = 8 >> shift
    index = pixels[:, x >> shift, G] >> ((x & ((1 << shift) - 1)) * depth) & ((1 << depth) - 1)
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file to its pixels, (height, width, 4) of alpha, red, green, blue."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + int.from_bytes(data[16:20], "little")])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            steps.append((kind, shift, read_image(bits, -(-wide >> shift), -(-height >> shift), False)))
        elif kind == PALETTE:
            table = read_image(bits, bits.read(8) + 1, 1, False)[0]
            table = np.cumsum(table.astype(np.int64), axis=0).astype(np.uint8)
            steps.append((kind, wide, table))
            wide = -(-wide >> bundle_shift(len(table)))
        else:
            steps.append((kind, 0, None))
    pixels = read_image(bits, wide, height, True)
    for kind, shift, extra in reversed(steps):
        if kind == PREDICTOR:
            pixels = undo_predictor(pixels, extra[..., G], shift)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, extra, shift, 1)
        elif kind == PALETTE:
            pixels = undo_palette(pixels, extra, shift)
        else:
            pixels = pixels.copy()
            pixels[..., R] += pixels[..., G]
            pixels[..., B] += pixels[..., G]
    return pixels


# ---- encoding


def _number(value: int, n: int) -> np.ndarray:
    return (value >> np.arange(n) & 1).astype(np.uint8)


def _file(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) % 2)
    return b"RIFF" + (12 + len(stream) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + pad


def _wrap(parts: list[np.ndarray], width: int, height: int) -> bytes:
    head = [_number(0x2F, 8), _number(width - 1, 14), _number(height - 1, 14), _number(1, 1), _number(0, 3)]
    return _file(np.packbits(np.concatenate(head + parts), bitorder="little").tobytes())


def _depths(weight: list[int]) -> list[int]:
    """Depths in the Huffman tree of at least two rising weights."""
    n = len(weight)
    none = sum(weight) + 1
    leaves, inner = [*weight, none + 1], [none] * n  # leaves and inner nodes both come in rising order
    up_leaf, up_inner = [0] * n, [0] * n
    leaf = node = 0
    for new in range(n - 1):
        if leaves[leaf] <= inner[node]:
            pair = leaves[leaf]
            up_leaf[leaf] = new
            leaf += 1
        else:
            pair = inner[node]
            up_inner[node] = new
            node += 1
        if leaves[leaf] <= inner[node]:
            inner[new] = pair + leaves[leaf]
            up_leaf[leaf] = new
            leaf += 1
        else:
            inner[new] = pair + inner[node]
            up_inner[node] = new
            node += 1
    deep = [1] * n
    for k in range(n - 3, -1, -1):
        deep[k] = deep[up_inner[k]] + 1
    return [deep[k] for k in up_leaf]


def _limited(weight: list[int], most: int) -> list[int]:
    """Depths of at most ``most``: small weights are raised until none is over it."""
    floor = 1
    while True:
        depth = _depths([max(w, floor) for w in weight] if floor > 1 else weight)
        if max(depth) <= most:
            return depth
        floor *= 2


def lengths_of(counts: np.ndarray, most: int = 14) -> np.ndarray:
    """Huffman code lengths of at most ``most``; one used symbol has length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    out[order] = _limited(counts[order].tolist(), most)
    return out


#: the code that code lengths are written in: of 1 to 14, one zero, and runs of zeros (17, 18)
_WIDTHS = np.array([4, 6, 6, 5, 4, 3, 3, 3, 3, 4, 5, 6, 6, 6, 6, 0, 0, 3, 5])
LONGEST = 14
_CODES = np.zeros(19, np.int64)
_order = np.argsort(np.where(_WIDTHS > 0, _WIDTHS, 99), kind="stable")[: np.count_nonzero(_WIDTHS)]
_taken = 1 << (LONGEST - _WIDTHS[_order])
_CODES[_order] = reversed_bits(LONGEST)[np.cumsum(_taken) - _taken]
_LAST = max(i for i, s in enumerate(LENGTH_ORDER) if _WIDTHS[s]) + 1
#: how each prefix code of that kind begins: no simple code, the widths above
_OPENING, _OPENING_BITS = _LAST - 4 << 1 | sum(int(_WIDTHS[s]) << 5 + 3 * k for k, s in enumerate(LENGTH_ORDER[:_LAST])), 5 + 3 * _LAST

#: where the five alphabets (the first with the largest cache) begin among an image's symbols
_ALPHABETS = np.array([0, 536, 792, 1048, 1304, 1344])
_PLACE_BITS = 20  # pixels of a batch at most


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each pair, back to back."""
    return np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)


def packed(values: np.ndarray, widths: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Numbers of given widths (up to 63 bits), lowest bit first, back to back: ``count`` of them to each stream."""
    total = np.concatenate(([0], np.cumsum(widths)))
    edge = np.concatenate(([0], np.cumsum(count)))
    size = total[edge[1:]] - total[edge[:-1]]
    words = (size + 63) >> 6
    first = np.cumsum(words) - words
    at = total[:-1] + np.repeat(64 * first - total[edge[:-1]], count)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    values = values.astype(np.uint64)
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    fresh = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[fresh]] = np.bitwise_or.reduceat(values << shift, fresh)
    over = (values >> np.uint64(1)) >> (np.uint64(63) - shift)
    some = np.flatnonzero(over)
    out[word[some] + 1] |= over[some]  # one number at most runs over the end of a word
    raw = out.astype("<u8").tobytes()
    return [raw[8 * a : 8 * a + (n + 7) // 8] for a, n in zip(first.tolist(), size.tolist(), strict=True)]


def matches(colour: np.ndarray, image: np.ndarray, ends: np.ndarray, least: int = 4, most: int = 4096) -> np.ndarray:
    """(place, length, distance) of repeats, in order and apart, to the last place of the same image where the same three pixels stood.

    image: of each pixel; ends: of each image. Images of under 16 pixels have none.
    """
    none = np.zeros((0, 3), np.int64)
    if len(colour) < 3:
        return none
    with np.errstate(over="ignore"):
        wide = colour.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key = wide[:-2] + (wide[1:-1] << np.uint64(21) | wide[1:-1] >> np.uint64(43)) * np.uint64(3) + (wide[2:] << np.uint64(42) | wide[2:] >> np.uint64(22)) * np.uint64(5)
    fits = image[2:] == image[:-2]
    fits &= (np.diff(ends, prepend=0) >= 16)[image[:-2]]
    # by key, then by place: both in one number
    low = np.uint64((1 << _PLACE_BITS) - 1)
    key = np.sort((key & ~low | np.arange(len(key), dtype=np.uint64))[fits])
    place = (key & low).astype(np.int64)
    same = np.flatnonzero((key[1:] ^ key[:-1]) <= low)
    here, there = place[1:][same], place[:-1][same]
    # equal keys are equal pixels but for a collision of 44 bits
    good = image[here] == image[there]
    for k in range(3):
        good &= colour[here + k] == colour[there + k]
    back = np.zeros(len(colour), np.int64)
    back[here[good]] = (here - there)[good]
    edge = np.flatnonzero(np.concatenate(([True], (back[1:] != back[:-1]) | (image[1:] != image[:-1]), [True])))
    a, b = edge[:-1], edge[1:] + 2
    some = np.flatnonzero((back[a] > 0) & (b - a >= least))
    out, free = [], 0
    for a, b, distance in zip(a[some].tolist(), b[some].tolist(), back[a[some]].tolist(), strict=True):
        a = max(a, free)
        while b - a >= least:
            length = min(b - a, most)
            out.append((a, length, distance))
            free = a = a + length
    return np.array(out, np.int64) if out else none


def _split_number(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number for lengths or distance codes."""
    value = value - 1
    more = np.maximum(np.frexp(np.maximum(value, 1).astype(float))[1] - 2, 0)
    more = np.where(value < 4, 0, more)
    return np.where(value < 4, value, 2 * more + 2 + (value >> more & 1)), value & ((1 << more) - 1), more


_NEAR_CODE: dict[int, np.ndarray] = {}  # by width: the code of each distance that has a short one


def _distance_codes(distance: np.ndarray, width: int) -> np.ndarray:
    if width not in _NEAR_CODE:
        near = np.zeros(8 + 7 * width + 1, np.int64)
        for k, (dx, dy) in reversed(list(enumerate(NEAR, 1))):
            near[max(1, dx + dy * width)] = k
        if len(_NEAR_CODE) > 64:
            _NEAR_CODE.clear()
        _NEAR_CODE[width] = near
    near = _NEAR_CODE[width]
    short = near[np.minimum(distance, len(near) - 1)]
    return np.where((distance < len(near)) & (short > 0), short, distance + 120)


def _codes_of_all(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From how often each symbol of each code occurs (codes of all images, one after the other in ``_ALPHABETS``): code lengths, codes, and bits a symbol (none where it stands alone)."""
    used = np.flatnonzero(counts)
    many = counts[used]
    image, inside = np.divmod(used, _ALPHABETS[-1])
    code = 5 * image + np.searchsorted(_ALPHABETS, inside, side="right") - 1
    # rising counts within each code, then by symbol
    order = np.argsort((code << 24) + many, kind="stable")
    bounds = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True]))).tolist()
    rising, found, alone = many[order].tolist(), [], np.zeros(len(used), bool)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a < 2:
            found.append(1)
            alone[a] = True
        else:
            found += _limited(rising[a:b], LONGEST)
    length = np.zeros(len(used), np.int64)
    length[order] = found
    order = np.argsort((code << 4) + length, kind="stable")
    taken = 1 << (LONGEST - length[order])
    ahead = np.cumsum(taken) - taken
    ahead -= np.repeat(ahead[bounds[:-1]], np.diff(bounds))
    lengths, codes, widths = (np.zeros(len(counts), np.int64) for _ in range(3))
    lengths[used] = length
    codes[used[order]] = reversed_bits(LONGEST)[ahead]
    codes[used[alone]] = 0
    widths[used] = np.where(alone, 0, length)
    return lengths, codes, widths


def _code_fields(lengths: np.ndarray, images: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix codes of all images as numbers, their widths, and how many each of the five codes of each image has."""
    used = np.flatnonzero(lengths)
    image, inside = np.divmod(used, _ALPHABETS[-1])
    channel = np.searchsorted(_ALPHABETS, inside, side="right") - 1
    code, symbol = 5 * image + channel, inside - _ALPHABETS[channel]
    n = np.bincount(code, minlength=5 * images)
    first = np.cumsum(n) - n
    only = np.zeros(5 * images, np.int64)
    only[n == 1] = symbol[first[n == 1]]
    simple = (n == 0) | (n == 1) & (only < 256)
    # others: an opening, the number of runs, runs of zeros and lengths
    keep = ~simple[code]
    code, symbol, length = code[keep], symbol[keep], lengths[used][keep]
    gap = np.diff(symbol, prepend=-1) - 1
    start = np.concatenate(([True], code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
    gap[start] = symbol[start]
    full, rest = np.divmod(gap, 138)
    runs = full + np.where(rest >= 3, 1, rest) + 1
    end = np.cumsum(runs)
    own = np.repeat(np.arange(len(runs)), runs)
    k = np.arange(len(own)) - (end - runs)[own]
    rest_of = rest[own]
    last = k == runs[own] - 1
    kind = np.where(last, length[own], np.where(k < full[own], 18, np.where(rest_of < 3, 0, np.where(rest_of > 10, 18, 17))))
    extra = np.where(last | (kind == 0), 0, np.where(k < full[own], 127, np.where(kind == 18, rest_of - 11, rest_of - 3)))
    count = np.bincount(code, runs, 5 * images).astype(np.int64)
    # the number of runs, less two, in as many pairs of bits as it takes
    left = count - 2
    pairs = np.maximum(1, (np.frexp(np.maximum(left, 0).astype(float))[1] + 1) // 2)
    fields = np.where(simple, 1, count + 2)
    at = np.cumsum(fields) - fields
    value, width = np.zeros(int(fields.sum()), np.int64), np.zeros(int(fields.sum()), np.int64)
    value[at[simple]], width[at[simple]] = 0b101 | only[simple] << 3, 11
    normal = np.flatnonzero(~simple)
    value[at[normal]], width[at[normal]] = _OPENING, _OPENING_BITS
    value[at[normal] + 1], width[at[normal] + 1] = (1 | pairs - 1 << 1 | left << 4)[normal], (4 + 2 * pairs)[normal]
    to = _ranges(at[normal] + 2, count[normal])
    value[to], width[to] = _CODES[kind] | extra << _WIDTHS[kind], _WIDTHS[kind] + np.where(kind == 18, 7, np.where(kind == 17, 3, 0))
    return value, width, fields


Fields = list[tuple[int, int]]


def numbers(images: list[tuple[Fields, np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (what goes before, (height, width, 4) pixels, main image or not) its bits as ``packed`` takes them: back-references, a colour cache where it pays, prefix codes.

    The images are coded side by side, each as it would be alone: the steps go over the pixels of all.
    """
    colour = np.concatenate([np.ascontiguousarray(pixels).view(">u4").ravel() for _, pixels, _ in images]).astype(np.uint32)
    size = np.array([pixels.shape[0] * pixels.shape[1] for _, pixels, _ in images])
    ends = np.cumsum(size)
    image = np.repeat(np.arange(len(images)), size)
    found = matches(colour, image, ends)
    covered = np.zeros(len(colour) + 1, np.int64)
    covered[found[:, 0]] += 1
    covered[found[:, 0] + found[:, 1]] -= 1
    single = np.cumsum(covered[:-1]) == 0
    # a colour cache: hits are pixels that are the last one before them in their place
    cache_bits = np.array([min(8, n.bit_length() - 3) if n >= 64 else 0 for n in size.tolist()])
    place = (colour * np.uint32(_CACHE_FACTOR)) >> (np.uint32(32) - np.maximum(cache_bits, 1).astype(np.uint32))[image]
    low = np.uint64((1 << _PLACE_BITS) - 1)
    order = (np.sort((image << 28 | place.astype(np.int64) << _PLACE_BITS).astype(np.uint64) | np.arange(len(colour), dtype=np.uint64)) & low).astype(np.int64)
    hit = np.zeros(len(colour), bool)
    hit[order[1:]] = (colour[order[1:]] == colour[order[:-1]]) & (image[order[1:]] == image[order[:-1]])
    hit &= single
    pays = (cache_bits > 0) & (np.bincount(image[hit], minlength=len(images)) * 3 >= size)  # a cache makes every code longer
    hit &= pays[image]
    starts = single.copy()
    starts[found[:, 0]] = True
    starts = np.flatnonzero(starts)
    colour, place, hit, single = colour[starts], place[starts].astype(np.int64), hit[starts], single[starts]
    base = image[starts] * _ALPHABETS[-1]
    channels = np.ascontiguousarray(colour.astype("<u4")).view(np.uint8).reshape(-1, 4).astype(np.int64)  # blue, green, red, alpha
    first = base + np.where(hit, 280 + place, channels[:, 1])
    plain, copy = np.flatnonzero(single & ~hit), np.flatnonzero(~single)
    kind, length_extra, length_bits = _split_number(found[:, 1])
    first[copy] = base[copy] + 256 + kind
    width = np.array([pixels.shape[1] for _, pixels, _ in images])[image[found[:, 0]]]
    short = np.zeros(len(found), np.int64)
    for w in np.unique(width).tolist():
        short[width == w] = _distance_codes(found[width == w, 2], w)
    far, far_extra, far_bits = _split_number(short)
    far += base[copy] + _ALPHABETS[4]
    others = [base[plain] + _ALPHABETS[k] + channels[plain, c] for k, c in ((1, 2), (2, 0), (3, 3))]
    counts = np.bincount(np.concatenate((first, *others, far)), minlength=len(images) * int(_ALPHABETS[-1]))
    lengths, codes, widths = _codes_of_all(counts)
    # all of a pixel, or of a reference, is one number
    value, bits = codes[first], widths[first]
    for which in others:
        value[plain] |= codes[which] << bits[plain]
        bits[plain] += widths[which]
    for part, more in ((length_extra, length_bits), (codes[far], widths[far]), (far_extra, far_bits)):
        value[copy] |= part << bits[copy]
        bits[copy] += more
    code_value, code_width, fields = _code_fields(lengths, len(images))
    lead = [[*before, (1 | cached << 1, 5) if cached else (0, 1), *([(0, 1)] if top else [])] for (before, _, top), cached in zip(images, np.where(pays, cache_bits, 0).tolist(), strict=True)]
    n_lead, n_codes, n_pixels = np.array([len(x) for x in lead]), fields.reshape(-1, 5).sum(axis=1), np.bincount(image[starts], minlength=len(images))
    count = n_lead + n_codes + n_pixels
    at = np.cumsum(count) - count
    values, sizes = np.zeros(int(count.sum()), np.int64), np.zeros(int(count.sum()), np.int64)
    to = _ranges(at, n_lead)
    values[to], sizes[to] = np.array([f for x in lead for f in x], np.int64).T
    to = _ranges(at + n_lead, n_codes)
    values[to], sizes[to] = code_value, code_width
    to = _ranges(at + n_lead + n_codes, n_pixels)
    values[to], sizes[to] = value, bits
    return values, sizes, count


def _entropy(*channels: np.ndarray) -> float:
    """Bits that the channels take by their own frequencies."""
    size = channels[0].size
    n = np.concatenate([np.bincount(c.ravel()) for c in channels])
    n = n[n > 1]
    return float(len(channels) * size * np.log2(size) - (n * np.log2(n)).sum())


def _one_pixel(pixel: tuple[int, int, int, int]) -> Fields:
    """An image of one colour, however large: alpha, red, green, blue."""
    a, r, g, b = pixel
    return [(0, 1), *((0b101 | v << 3, 11) for v in (g, r, b, a, 0))]


_WIDEST = 9  # blocks of 512 pixels: one for a strip


def compress(rgb: np.ndarray) -> bytes:
    """(height, width, 3) of red, green, blue, at most 512 to a side, to a file."""
    return compress_all([rgb])[0]


def compress_all(images: list[np.ndarray]) -> list[bytes]:
    """As ``compress``, for images of at most a million pixels together."""
    return [_file(stream) for stream in packed(*numbers([transformed(rgb) for rgb in images]))]


def transformed(rgb: np.ndarray) -> tuple[Fields, np.ndarray, bool]:
    """What a file begins with, and the pixels by the transform with the least entropy."""
    height, width, _ = rgb.shape
    pixels = np.full((height, width, 4), 255, np.uint8)
    pixels[..., 1:] = rgb
    red, green, blue = (rgb[..., k] for k in range(3))
    best, cost = None, _entropy(red, green, blue)
    # predictors: the pixel to the left, or above; tried where a third of the bytes are close to it
    for mode, step in ((1, rgb[:, 1:] - rgb[:, :-1]), (2, rgb[1:] - rgb[:-1])):
        if step.size and np.count_nonzero(step + np.uint8(8) <= 16) * 3 >= step.size:
            left = rgb.copy()
            left[1:, 0], left[0, 1:] = rgb[1:, 0] - rgb[:-1, 0], rgb[0, 1:] - rgb[0, :-1]
            left[1:, 1:] = step[1:] if mode == 1 else step[:, 1:]
            if (now := _entropy(left[..., 0], left[..., 1], left[..., 2]) + 80) < cost:
                best, cost = (PREDICTOR, mode, left), now
    # cross-colour: red and blue less a multiple of green; tried where they go with it
    flat = rgb.reshape(-1, 3).view(np.int8).astype(np.float32)
    flat -= flat.mean(axis=0)
    spread = np.einsum("ij,ik->jk", flat, flat)  # not a product of matrices: that would take all cores
    if all(spread[1, k] ** 2 > 0.25 * spread[1, 1] * spread[k, k] for k in (0, 2)):
        slopes = [int(np.clip(np.round(32 * spread[1, k] / spread[1, 1]), -128, 127)) for k in (0, 2)]
        element = np.array([[[255, 0, slopes[1] & 255, slopes[0] & 255]]], np.uint8)
        turned = cross_colour(pixels, element, _WIDEST, -1)
        if (now := _entropy(turned[..., R], green, turned[..., B]) + 80) < cost:
            best, cost = (CROSS_COLOUR, element, turned), now
    parts = [(1, 1)]
    colour = np.ascontiguousarray(pixels).view(">u4").ravel().astype(np.uint32)
    table = None
    if len(colour) >= 64 and len(np.unique(colour[:: max(1, len(colour) // 200)])) <= 128:  # else there are too many colours
        table = np.unique(colour, return_inverse=True)
    if table is not None and len(table[0]) <= 256 and _entropy(table[1]) + 20 * len(table[0]) < cost:
        colours, index = table[0].astype(">u4").view(np.uint8).reshape(-1, 4), table[1].reshape(height, width)
        bundle = bundle_shift(len(colours))
        rising = np.diff(colours.astype(np.int64), axis=0, prepend=np.zeros((1, 4), np.int64)).astype(np.uint8)
        small = np.zeros((height, -(-width >> bundle), 4), np.uint8)
        small[..., A] = 255
        for x in range(1 << bundle):
            columns = index[:, x :: 1 << bundle]
            small[:, : columns.shape[1], G] |= (columns << (x * (8 >> bundle))).astype(np.uint8)
        value, bits, _ = numbers([([], rising[None], False)])
        parts += [(PALETTE, 2), (len(colours) - 1, 8), *zip(value.tolist(), bits.tolist(), strict=True)]
        pixels = small
    elif best is None:
        parts = []
    elif best[0] == PREDICTOR:
        parts += [(PREDICTOR, 2), (_WIDEST - 2, 3), *_one_pixel((255, 0, best[1], 0))]
        pixels[..., 1:] = best[2]
        pixels[..., A] = 0
    else:
        parts += [(CROSS_COLOUR, 2), (_WIDEST - 2, 3), *_one_pixel(tuple(best[1][0, 0].tolist()))]
        pixels = best[2]
    return [(0x2F | width - 1 << 8 | height - 1 << 22 | 1 << 36, 40), *parts, (0, 1)], pixels, True


def _code_lengths(counts: Counter, alphabet: int, most: int = 15) -> np.ndarray:
    """Huffman code lengths, flattened until none is over ``most``."""
    lengths = np.zeros(alphabet, np.int64)
    floor = 1
    while counts:
        heap = [(max(n, floor), k, (s,)) for k, (s, n) in enumerate(sorted(counts.items()))]
        lengths[:] = 0
        heapq.heapify(heap)
        if len(heap) == 1:
            lengths[heap[0][2][0]] = 1
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            lengths[list(a[2] + b[2])] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if lengths.max() <= most:
            break
        floor *= 2
    return lengths


def _canonical(lengths: np.ndarray) -> dict[int, np.ndarray]:
    out, code, before = {}, 0, 0
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return {int(used[0]): np.zeros(0, np.uint8)}
    for s in used[np.argsort(lengths[used], kind="stable")].tolist():
        code <<= int(lengths[s]) - before
        before = int(lengths[s])
        out[s] = _number(code, before)[::-1]
        code += 1
    return out


def _write_prefix(lengths: np.ndarray) -> list[np.ndarray]:
    """A normal code, with runs of zeros and of equal lengths shortened."""
    used = np.flatnonzero(lengths)
    if not len(used):
        return [_number(0b101, 3), _number(0, 8)]
    if len(used) <= 2 and used[-1] < 256:
        return [_number(1, 1), _number(len(used) - 1, 1), _number(1, 1), *(_number(int(s), 8) for s in used)]
    runs, at = [], 0
    while at < len(lengths):
        n = 1
        while at + n < len(lengths) and lengths[at + n] == lengths[at]:
            n += 1
        value, at = int(lengths[at]), at + n
        if value:
            runs.append((value, 0, 0))
            n -= 1
        while n >= 3:
            symbol, least, most, width = (16, 3, 6, 2) if value else (17, 3, 10, 3) if n < 11 else (18, 11, 138, 7)
            take = min(n, most)
            runs.append((symbol, take - least, width))
            n -= take
        runs += [(value, 0, 0)] * n
    outer = _code_lengths(Counter(s for s, _, _ in runs), 19, 7)
    codes = _canonical(outer)
    n = max(i for i, s in enumerate(LENGTH_ORDER) if outer[s]) + 1
    parts = [_number(0, 1), _number(max(n, 4) - 4, 4), *(_number(int(outer[s]), 3) for s in LENGTH_ORDER[: max(n, 4)]), _number(0, 1)]
    for symbol, extra, width in runs:
        parts += [codes[symbol], _number(extra, width)]
    return parts


def _prefixed(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number for a length or distance code."""
    value -= 1
    if value < 4:
        return value, 0, 0
    n = value.bit_length() - 2
    return 2 * n + 2 + (value >> n & 1), value & ((1 << n) - 1), n


def _write_image(pixels: np.ndarray, top: bool, cache_bits: int = 0, references: bool = False, groups: np.ndarray | None = None, shift: int = 2) -> list[np.ndarray]:
    height, width, _ = pixels.shape
    flat = [int.from_bytes(p.tobytes(), "big") for p in pixels.reshape(-1, 4)]
    cache: dict[int, int] = {}
    seen: dict[tuple[int, ...], int] = {}
    near = {}
    for code in range(120, 0, -1):
        near[max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)] = code
    symbols: list[tuple[int, list[tuple[int, int, int, int]]]] = []  # place, and (alphabet, symbol, extra, bits)
    at, noted = 0, 0
    while at < len(flat):
        length, before = 0, seen.get(tuple(flat[at : at + 3])) if references else None
        if before is not None:
            while at + length < len(flat) and length < 4096 and flat[before + length] == flat[at + length]:
                length += 1
        if length >= 3:
            distance = at - before
            out = [(0, *_prefixed(length)), (4, *_prefixed(near.get(distance, distance + 120)))]
            out[0] = (0, out[0][1] + 256, *out[0][2:])
        elif cache_bits and cache.get((_CACHE_FACTOR * flat[at] & 0xFFFFFFFF) >> (32 - cache_bits)) == flat[at]:
            length, out = 1, [(0, 280 + ((_CACHE_FACTOR * flat[at] & 0xFFFFFFFF) >> (32 - cache_bits)), 0, 0)]
        else:
            length, p = 1, flat[at]
            out = [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]
        symbols.append((at, out))
        at += length
        for noted in range(noted, at):
            if cache_bits:
                cache[(_CACHE_FACTOR * flat[noted] & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[noted]
            seen[tuple(flat[noted : noted + 3])] = noted
        noted = at
    parts = [_number(1, 1), _number(cache_bits, 4)] if cache_bits else [_number(0, 1)]
    if top:
        parts.append(_number(int(groups is not None), 1))
        if groups is not None:
            small = np.zeros((*groups.shape, 4), np.uint8)
            small[..., R], small[..., G] = groups >> 8, groups & 255
            parts += [_number(shift - 2, 3), *_write_image(small, False)]
    of = (lambda i: int(groups[i // width >> shift, i % width >> shift])) if groups is not None else (lambda i: 0)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    n = 1 if groups is None else int(groups.max()) + 1
    counts = [[Counter() for _ in sizes] for _ in range(n)]
    for i, out in symbols:
        for kind, symbol, _, _ in out:
            counts[of(i)][kind][symbol] += 1
    lengths = [[_code_lengths(c, m) for c, m in zip(group, sizes, strict=True)] for group in counts]
    for group in lengths:
        for code in group:
            parts += _write_prefix(code)
    codes = [[_canonical(c) for c in group] for group in lengths]
    for i, out in symbols:
        for kind, symbol, extra, width_ in out:
            parts += [codes[of(i)][kind][symbol], _number(extra, width_)]
    return parts


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), modes: np.ndarray | None = None, elements: np.ndarray | None = None, shift: int = 2, cache_bits: int = 0, references: bool = True, groups: np.ndarray | None = None) -> bytes:
    """(height, width, 4) pixels to a file with any of the format's means, pixel by pixel.

    modes (predictor) and elements (cross-colour) are block images for ``shift``; a palette
    takes at most 256 colours.
    """
    height, width, _ = pixels.shape
    parts, now = [], pixels
    for kind in transforms:
        parts += [_number(1, 1), _number(kind, 2)]
        if kind == PREDICTOR:
            image = np.zeros((*modes.shape, 4), np.uint8)
            image[..., G] = modes
            parts += [_number(shift - 2, 3), *_write_image(image, False)]
            now = _apply_predictor(now, modes, shift)
        elif kind == CROSS_COLOUR:
            parts += [_number(shift - 2, 3), *_write_image(elements, False)]
            now = cross_colour(now, elements, shift, -1)
        elif kind == SUBTRACT_GREEN:
            now = now.copy()
            now[..., R] -= now[..., G]
            now[..., B] -= now[..., G]
        else:
            table, index = np.unique(now.reshape(-1, 4), axis=0, return_inverse=True)
            rising = np.diff(table.astype(np.int64), axis=0, prepend=np.zeros((1, 4), np.int64)).astype(np.uint8)
            parts += [_number(len(table) - 1, 8), *_write_image(rising[None], False)]
            bundle = bundle_shift(len(table))
            index = index.reshape(height, now.shape[1])
            small = np.zeros((height, -(-now.shape[1] >> bundle), 4), np.uint8)
            small[..., A] = 255
            for x in range(now.shape[1]):
                small[:, x >> bundle, G] |= (index[:, x] << ((x & ((1 << bundle) - 1)) * (8 >> bundle))).astype(np.uint8)
            now = small
    parts += [_number(0, 1), *_write_image(now, True, cache_bits, references, groups, shift)]
    return _wrap(parts, width, height)


def _apply_predictor(pixels: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width, _ = pixels.shape
    full = pixels.astype(np.int64)
    out = full.copy()
    for y in range(height):
        for x in range(width):
            if not x and not y:
                guess = np.array([255, 0, 0, 0])
            elif not y:
                guess = full[y, x - 1]
            elif not x:
                guess = full[y - 1, x]
            else:
                right = full[y - 1, x + 1] if x + 1 < width else full[y, 0]
                guess = predict(int(modes[y >> shift, x >> shift]), full[y, x - 1], full[y - 1, x], full[y - 1, x - 1], right)
            out[y, x] = (full[y, x] - guess) & 255
    return out.astype(np.uint8)


# ---- texts as media


def payload_of(text: bytes) -> bytes:
    return text + b" " * ((-len(text) % ROW) if text else ROW)


def strips_of(payload: bytes) -> list[np.ndarray]:
    step = ROW * STRIP_ROWS
    return [np.frombuffer(payload[at : at + step], np.uint8).reshape(-1, WIDTH, 3) for at in range(0, len(payload), step)]


def write_strips(payload: bytes) -> bytes:
    return write_all([payload])[0]


def write_all(payloads: list[bytes]) -> list[bytes]:
    """The media of each payload; strips are coded ``TOGETHER`` pixels at a time, whatever payload they belong to."""
    media: list[list[bytes]] = [[] for _ in payloads]
    held: list[tuple[int, np.ndarray]] = []
    pixels = 0
    for k, strip in ((k, strip) for k, payload in enumerate(payloads) for strip in strips_of(payload)):
        held.append((k, strip))
        pixels += strip.shape[0] * WIDTH
        if pixels >= TOGETHER:
            for (of, _), file in zip(held, compress_all([x for _, x in held]), strict=True):
                media[of].append(file)
            held, pixels = [], 0
    if held:
        for (of, _), file in zip(held, compress_all([x for _, x in held]), strict=True):
            media[of].append(file)
    return [b"".join(files) for files in media]


def read_strips(media: bytes) -> np.ndarray:
    """Pixels of all strips, one below the other."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(decode(media[at : at + size]))
        at += size
    return np.concatenate(out) if len(out) > 1 else out[0]


def feature_of(pixels: np.ndarray) -> str:
    """Height, and the mean and deviation of red, green and blue."""
    rgb = pixels[..., 1:].reshape(-1, 3)
    n = len(rgb)
    rows = rgb.T.astype(np.int64, order="C")
    total, square = rows.sum(axis=1), np.einsum("ij,ij->i", rows, rows)
    mean, spread = total / n, np.sqrt(np.maximum(square / n - (total / n) ** 2, 0))
    return f"{pixels.shape[0]}:" + ":".join(f"{m:.3f},{s:.3f}" for m, s in zip(mean.tolist(), spread.tolist(), strict=True))


def store(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row per document with the digests of its stored form and of what was read back from it; ``media`` on demand."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def make():
        def one(raw: bytes, media: bytes) -> tuple:
            pixels = read_strips(media)
            back = np.ascontiguousarray(pixels[..., 1:]).tobytes()
            row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pixels))
            return (*row, media) if keep_media else row

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            given = batch.column(1).to_pylist()
            fresh = list(dict.fromkeys(given))  # copies beside each other are coded once
            raw = [(text or "").encode() for text in fresh]
            known = {text: one(r, m) for text, r, m in zip(fresh, raw, write_all([payload_of(r) for r in raw]), strict=True)}
            rows = list(zip(*(known[text] for text in given), strict=True))
            more = [pa.array(rows[-1], pa.binary())] if keep_media else []
            return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=False)), *more], names=names + ["media"] * keep_media)

        return work

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_slices(texts(docs), make, schema + ", media binary" * keep_media)
