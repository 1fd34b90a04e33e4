"""Lossless WebP (VP8L): a decoder for pixel arrays, and a plain encoder.

``decode`` reads one RIFF/WebP file of the lossless kind: prefix codes (simple
and normal), meta prefix images, back-references with the distance map, colour
cache, and the predictor, cross-colour, subtract-green and palette transforms
(with pixel bundling). ``decode_many`` reads a batch: images with one prefix
code group advance together, one pixel per step and image, in numpy; the
inverse transforms are whole-array operations. Both give (height, width, 4)
uint8 arrays in R, G, B, A order.

``encode`` writes images with one prefix code group: literals, back-references
to matching pixels at any distance, and a colour cache. Predictors and
multipliers are chosen by tile; of plain pixels, subtract-green, predictor,
cross-colour, both of them and palette, the one with the least entropy is
written beside the plain form, and the smaller file kept. ``encode_many`` looks
for transforms and copies of many images at once. ``store_texts`` keeps texts
as such images.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
ALPHABETS = (256 + 24, 256, 256, 256, 40)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
MAX_SIDE, MAX_BITS = 1 << 14, 15


class WebPError(ValueError):
    """The bytes are not a lossless WebP image, or a damaged one."""


def distance_map() -> list[tuple[int, int]]:
    """The 120 nearby offsets (dx, dy) in the format's order: by squared
    distance, then as the format lists them."""
    # Code k stands for (x, y) with y in 0..7; listed by the
    # format as y * 16 + 8 - x.
    table = (
        0x18, 0x07, 0x17, 0x19, 0x28, 0x06, 0x27, 0x29, 0x16, 0x1A, 0x26, 0x2A, 0x38, 0x05, 0x37, 0x39, 0x15, 0x1B, 0x36, 0x3A,
        0x25, 0x2B, 0x48, 0x04, 0x47, 0x49, 0x14, 0x1C, 0x35, 0x3B, 0x46, 0x4A, 0x24, 0x2C, 0x58, 0x45, 0x4B, 0x34, 0x3C, 0x03,
        0x57, 0x59, 0x13, 0x1D, 0x56, 0x5A, 0x23, 0x2D, 0x44, 0x4C, 0x55, 0x5B, 0x33, 0x3D, 0x68, 0x02, 0x67, 0x69, 0x12, 0x1E,
        0x66, 0x6A, 0x22, 0x2E, 0x54, 0x5C, 0x43, 0x4D, 0x65, 0x6B, 0x32, 0x3E, 0x78, 0x01, 0x77, 0x79, 0x53, 0x5D, 0x11, 0x1F,
        0x64, 0x6C, 0x42, 0x4E, 0x76, 0x7A, 0x21, 0x2F, 0x75, 0x7B, 0x31, 0x3F, 0x63, 0x6D, 0x52, 0x5E, 0x00, 0x74, 0x7C, 0x41,
        0x4F, 0x10, 0x20, 0x62, 0x6E, 0x30, 0x73, 0x7D, 0x51, 0x5F, 0x40, 0x72, 0x7E, 0x61, 0x6F, 0x50, 0x71, 0x7F, 0x60, 0x70,
    )
    return [(8 - (c & 15), c >> 4) for c in table]


_NEAR = distance_map()


# ---------------------------------------------------------------- bits and codes


class Bits:
    """Little-endian bit reader over bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.byte, self.word, self.left = data, at, 0, 0

    def fill(self, n: int) -> None:
        while self.left < n:
            chunk = self.data[self.byte : self.byte + 8]
            if not chunk:
                if self.byte > len(self.data) + 64:
                    raise WebPError("the data end too early")
                chunk = bytes(8)
            self.word |= int.from_bytes(chunk, "little") << self.left
            self.left += 8 * len(chunk)
            self.byte += len(chunk)

    def take(self, n: int) -> int:
        if self.left < n:
            self.fill(n)
        v = self.word & ((1 << n) - 1)
        self.word >>= n
        self.left -= n
        return v

    @property
    def position(self) -> int:
        """Bits read so far."""
        return 8 * self.byte - self.left


def _reversal(n: int) -> np.ndarray:
    """The bit-reversed value of every n-bit number."""
    r = np.zeros(1, np.int64)
    for _ in range(n):
        r = np.concatenate([2 * r, 2 * r + 1])
    return r


_REVERSED = [_reversal(n) for n in range(MAX_BITS + 1)]
_REVERSED_SMALL = [_REVERSED[n].tolist() for n in range(8)]


def _ordered(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Used symbols in canonical order, their sizes, and their codes moved to
    the left of ``MAX_BITS`` bits: each the sum of the shares before it."""
    used = lengths.nonzero()[0]
    order = used[lengths[used].astype(np.uint8).argsort(kind="stable")]
    size = lengths[order]
    share = np.int64(1) << (MAX_BITS - size)
    left = share.cumsum() - share
    if len(order) > 1 and left[-1] + share[-1] != 1 << MAX_BITS:
        raise WebPError("a prefix code is not complete")
    return order, size, left


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes (bits reversed, as they are read) from code lengths."""
    codes = np.zeros(len(lengths), np.int64)
    order, _, left = _ordered(lengths)
    codes[order] = _REVERSED[MAX_BITS][left]
    return codes


class Code:
    """A prefix code as one lookup table: entry = symbol << 4 | length, in 16 bits."""

    def __init__(self, lengths: np.ndarray, alone: int | None = None):
        self.entries: list | None = None
        if alone is not None:  # the one symbol, whose length is known
            self.bits, self.table = 0, np.array([alone << 4], np.uint16)
            return
        order, size, _ = _ordered(lengths)
        if len(order) == 0:
            raise WebPError("an empty prefix code")
        if len(order) == 1:  # takes no bits
            self.bits, self.table = 0, (order << 4).astype(np.uint16)
        else:
            self.bits = int(size[-1])
            self.table = np.repeat((order << 4 | size).astype(np.uint16), 1 << (self.bits - size))[_REVERSED[self.bits]]

    def read(self, bits: Bits) -> int:
        if bits.left < 15:
            bits.fill(15)
        if self.entries is None:
            self.entries = self.table.tolist()
        e = self.entries[bits.word & ((1 << self.bits) - 1)]
        bits.word >>= e & 15
        bits.left -= e & 15
        return e >> 4


def _small_table(lengths: list[int]) -> tuple[list[int], int]:
    """The lookup table of a code of few symbols and at most seven bits, as in
    ``Code``, and the bits that it is looked up by."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if not used:
        raise WebPError("an empty prefix code")
    if len(used) == 1:  # takes no bits
        return [used[0][1] << 4], 0
    top = used[-1][0]
    table, at = [0] * (1 << top), 0
    back = _REVERSED_SMALL[top]
    for n, s in used:
        end = at + (1 << (top - n))
        if end > len(table):
            break
        # Codes of one length begin alike when read backwards: every 2^n-th entry.
        table[back[at] :: 1 << n] = [s << 4 | n] * (end - at)
        at = end
    else:
        if at == len(table):
            return table, top
    raise WebPError("a prefix code is not complete")


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.take(1):  # simple: one or two symbols
        two, wide = bits.take(1), bits.take(1)
        symbols = [bits.take(8 if wide else 1)]
        if two:
            symbols.append(bits.take(8))
        for s in symbols:
            if s >= size:
                raise WebPError("a symbol beyond its alphabet")
            lengths[s] = 1
        return Code(lengths, symbols[0] if len(symbols) == 1 else None)
    own = [0] * 19
    for i in range(4 + bits.take(4)):
        own[CODE_LENGTH_ORDER[i]] = bits.take(3)
    entries, top = _small_table(own)
    most = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    mask = (1 << top) - 1
    found: list[int] = []
    last, word, left = 8, bits.word, bits.left
    while len(found) < size and most:
        most -= 1
        if left < 15:  # a code and its extra bits
            bits.word, bits.left = word, left
            bits.fill(15)
            word, left = bits.word, bits.left
        e = entries[word & mask]
        s, n = e >> 4, e & 15
        word >>= n
        if s < 16:
            found.append(s)
            last = s or last
        elif s == 16:
            found += [last] * (3 + (word & 3))
            word >>= 2
            n += 2
        elif s == 17:
            found += [0] * (3 + (word & 7))
            word >>= 3
            n += 3
        else:
            found += [0] * (11 + (word & 127))
            word >>= 7
            n += 7
        left -= n
    bits.word, bits.left = word, left
    if len(found) > size:
        raise WebPError("code lengths run over")
    lengths[: len(found)] = found
    return Code(lengths)


def _extended(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix code and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


# ---------------------------------------------------------------- entropy-coded images


def _up(a: int, bits: int) -> int:
    return (a + (1 << bits) - 1) >> bits


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels of an entropy-coded image as uint32 ARGB."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    meta, meta_bits, groups = None, 0, 1
    if main and bits.take(1):
        meta_bits = bits.take(3) + 2
        meta = (_read_image(bits, _up(width, meta_bits), _up(height, meta_bits), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
        meta = meta.reshape(_up(height, meta_bits), -1)
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    return _scalar_pixels(bits, width, width * height, codes, meta, meta_bits, cache_bits)


def _scalar_pixels(bits: Bits, width: int, n: int, codes, meta, meta_bits: int, cache_bits: int, out: list[int] | None = None) -> np.ndarray:
    """Pixel by pixel; the general case. ``out``: pixels read already."""
    out = [] if out is None else out
    cache, shift = [0] * (1 << cache_bits if cache_bits else 0), 32 - cache_bits
    if cache_bits:
        for p in out:
            cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
    green, red, blue, alpha, dist = codes[0]
    while len(out) < n:
        at = len(out)
        if meta is not None:
            green, red, blue, alpha, dist = codes[int(meta[(at // width) >> meta_bits, (at % width) >> meta_bits])]
        s = green.read(bits)
        if s < 256:
            p = alpha_red = red.read(bits) << 16 | s << 8
            p = alpha_red | blue.read(bits)
            p |= alpha.read(bits) << 24
            out.append(p)
            if cache_bits:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
        elif s < 280:
            length = _extended(bits, s - 256)
            d = _extended(bits, dist.read(bits))
            if d > 120:
                d -= 120
            else:
                dx, dy = _NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + length > n:
                raise WebPError("a back-reference leaves the image")
            for k in range(at, at + length):
                p = out[k - d]
                out.append(p)
                if cache_bits:
                    cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
        else:
            if s - 280 >= len(cache):
                raise WebPError("a colour cache code without a cache")
            out.append(cache[s - 280])
    if bits.position > 8 * len(bits.data):
        raise WebPError("the data end too early")
    return np.array(out, np.uint32)


# ---------------------------------------------------------------- transforms


def _bytes_of(p: np.ndarray) -> np.ndarray:
    """uint32 ARGB -> (..., 4) int32 in A, R, G, B order."""
    return np.stack([(p >> s & 0xFF).astype(np.int32) for s in (24, 16, 8, 0)], -1)


def _packed(c: np.ndarray) -> np.ndarray:
    c = (c & 0xFF).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left, top, top_left, top_right):
    """One pixel's prediction; arguments are lists of four channels."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:  # the nearer of left and top to left + top - top_left
        to_left = sum(abs(t - q) for t, q in zip(top, top_left, strict=True))
        to_top = sum(abs(x - q) for x, q in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    clip = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode == 12:
        return [clip(a + b - c) for a, b, c in zip(left, top, top_left, strict=True)]
    mean = half(left, top)
    # Halving rounds toward zero.
    return [clip(a + int((a - c) / 2)) for a, c in zip(mean, top_left, strict=True)]


def _undo_predictor(p: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    c = _bytes_of(p)
    h, w = p.shape
    if h == 0 or w == 0:
        return p
    c[0, 0, 0] = (c[0, 0, 0] + 255) & 255
    c[0, 1:] += 0
    c[0] = np.cumsum(c[0], axis=0) & 255  # the first row uses left
    for y in range(1, h):
        row, above = c[y], c[y - 1]
        row[0] = (row[0] + above[0]) & 255
        x = 1
        while x < w:  # one tile at a time
            end, mode = min(w, ((x >> bits) + 1) << bits), int(modes[y >> bits, x >> bits])
            here = slice(x, end)
            top, top_left = above[here], above[x - 1 : end - 1]
            # Right of the last column is the row's own first pixel.
            top_right = above[x + 1 : end + 1] if end < w else np.concatenate([above[x + 1 : w], row[:1]])
            if mode in (0, 14, 15):
                row[here, 0] = (row[here, 0] + 255) & 255
            elif mode == 1:
                row[here] = (row[x - 1] + np.cumsum(row[here], axis=0)) & 255
            elif mode in (2, 3, 4, 8, 9):
                guess = {2: top, 3: top_right, 4: top_left, 8: (top_left + top) >> 1, 9: (top + top_right) >> 1}[mode]
                row[here] = (row[here] + guess) & 255
            else:  # needs the pixel just made
                left = row[x - 1].tolist()
                rest = row[here].tolist()
                for i, (a, b, d) in enumerate(zip(top.tolist(), top_left.tolist(), top_right.tolist(), strict=True)):
                    left = [(u + v) & 255 for u, v in zip(rest[i], _predict(mode, left, a, b, d), strict=True)]
                    rest[i] = left
                row[here] = rest
            x = end
    return _packed(c)


def _undo_cross_colour(p: np.ndarray, tiles: np.ndarray, bits: int) -> np.ndarray:
    h, w = p.shape
    t = np.repeat(np.repeat(tiles, 1 << bits, 0), 1 << bits, 1)[:h, :w]
    signed = lambda x: ((x & 0xFF).astype(np.int32) ^ 0x80) - 0x80
    delta = lambda a, b: (a * b) >> 5
    c = _bytes_of(p)
    green = signed(c[..., 2])
    red = c[..., 1] + delta(signed(t), green)
    blue = c[..., 3] + delta(signed(t >> 8), green) + delta(signed(t >> 16), signed(red))
    c[..., 1], c[..., 3] = red, blue
    return _packed(c)


def _undo_palette(p: np.ndarray, palette: np.ndarray, width: int, bits: int) -> np.ndarray:
    index = (p >> 8) & 0xFF
    if bits:
        per, depth = 1 << bits, 8 >> bits
        index = (index[..., None] >> (np.arange(per, dtype=np.uint32) * depth)) & ((1 << depth) - 1)
        index = index.reshape(p.shape[0], -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def _header(data: bytes) -> tuple[Bits, int, int]:
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebPError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            if at + 8 + size > len(data) or size < 5 or data[at + 8] != 0x2F:
                raise WebPError("a damaged VP8L chunk")
            bits = Bits(data[at + 8 : at + 8 + size], 1)
            width, height = bits.take(14) + 1, bits.take(14) + 1
            bits.take(1)
            if bits.take(3):
                raise WebPError("an unknown version")
            return bits, width, height
        at += 8 + size + (size & 1)
    raise WebPError("no VP8L chunk")


def _transforms(bits: Bits, width: int, height: int) -> tuple[list[tuple], int]:
    """The transforms in the order read, and the width they leave."""
    out, seen = [], set()
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise WebPError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.take(3) + 2
            w, h = _up(width, size), _up(height, size)
            tiles = _read_image(bits, w, h, False).reshape(h, w)
            out.append((kind, (tiles >> 8) & 0xF if kind == PREDICTOR else tiles, size))
        elif kind == SUBTRACT_GREEN:
            out.append((kind,))
        else:
            n = bits.take(8) + 1
            palette = _packed(np.cumsum(_bytes_of(_read_image(bits, n, 1, False)), axis=0))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            out.append((kind, palette, width, pack))
            width = _up(width, pack)
    return out, width


def _finish(p: np.ndarray, transforms: list[tuple], height: int) -> np.ndarray:
    p = p.reshape(height, -1)
    for t in reversed(transforms):
        if t[0] == PREDICTOR:
            p = _undo_predictor(p, t[1], t[2])
        elif t[0] == CROSS_COLOUR:
            p = _undo_cross_colour(p, t[1], t[2])
        elif t[0] == SUBTRACT_GREEN:
            c = _bytes_of(p)
            c[..., 1] += c[..., 2]
            c[..., 3] += c[..., 2]
            p = _packed(c)
        else:
            p = _undo_palette(p, t[1], t[2], t[3])
    stored = np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(*p.shape, 4)  # B, G, R, A
    out = np.empty_like(stored)
    for i, j in enumerate((2, 1, 0, 3)):
        out[..., i] = stored[..., j]
    return out


def decode(data: bytes) -> np.ndarray:
    """One image: (height, width, 4) uint8, R, G, B, A."""
    bits, width, height = _header(data)
    transforms, w = _transforms(bits, width, height)
    return _finish(_read_image(bits, w, height, True), transforms, height)


# ---------------------------------------------------------------- many images at once

LANES = 24


def decode_many(files: Sequence[bytes]) -> list[np.ndarray | WebPError]:
    """Like ``decode`` for each file; an error stands in for a damaged one."""
    out: list = [None] * len(files)
    lanes = []
    for i, data in enumerate(files):
        try:
            bits, width, height = _header(data)
            transforms, w = _transforms(bits, width, height)
            mark = (bits.byte, bits.word, bits.left)
            cache_bits = bits.take(4) if bits.take(1) else 0
            if bits.take(1) or cache_bits > 11 or w * height < 16:
                bits.byte, bits.word, bits.left = mark
                out[i] = _finish(_read_image(bits, w, height, True), transforms, height)
                continue
            codes = [read_code(bits, n) for n in (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])]
            lanes.append((w * height, i, bits, w, height, transforms, cache_bits, codes))
        except WebPError as e:
            out[i] = e
    lanes.sort(key=lambda x: -x[0])
    if lanes:
        pixels = _lockstep(lanes)
        for lane, p in zip(lanes, pixels, strict=True):
            out[lane[1]] = p if isinstance(p, WebPError) else _finish(p, lane[5], lane[4])
    return out


# By prefix code of a length or distance: its extra bits, their mask, and the least value.
_EXTRA = np.array([max(0, (c - 2) >> 1) for c in range(40)])
_MASK = (1 << _EXTRA) - 1
_LEAST = np.array([c + 1 if c < 4 else ((2 + (c & 1)) << ((c - 2) >> 1)) + 1 for c in range(40)])


def _lockstep(lanes: list[tuple]) -> list[np.ndarray | WebPError]:
    """Entropy decoding of all lanes (longest first), one pixel a step.

    All streams lie in one buffer; a lane's state is its bit position, the
    pixels still to copy and from where. Lanes whose image is complete leave at
    the end of the list. When few are left the scalar reader takes over.
    """
    k = len(lanes)
    count = np.array([x[0] for x in lanes], np.int64)
    pad = bytes(16)
    start, parts, at = [], [], 0
    for x in lanes:
        start.append(8 * at + x[2].position)
        parts += [x[2].data, pad]
        at += len(x[2].data) + 16
    halves = np.frombuffer(b"".join(parts) + pad + bytes(-at % 4), "<u4").astype(np.int64)
    words = halves[:-1] | halves[1:] << 32  # 64 bits from every fourth byte
    del halves
    pos = np.array(start, np.int64)
    end = np.array([8 * len(x[2].data) for x in lanes], np.int64) + np.cumsum([0, *(8 * (len(x[2].data) + 16) for x in lanes[:-1])])
    base, mask, tables, off = np.zeros((5, k), np.int64), np.zeros((5, k), np.int64), [], 0
    known: dict[int, int] = {}
    for i, x in enumerate(lanes):
        for c, code in enumerate(x[7]):
            base[c, i], mask[c, i] = off, (1 << code.bits) - 1
            tables.append(code.table)
            off += len(code.table)
    table = np.concatenate(tables)
    del tables, known
    cache_bits = np.array([x[6] for x in lanes], np.int64)
    cache_at = np.cumsum(np.where(cache_bits > 0, 1 << cache_bits, 1)) - np.where(cache_bits > 0, 1 << cache_bits, 1)
    cache = np.zeros(int(cache_at[-1]) + (1 << 11) + 1, np.uint32)
    shift = (32 - cache_bits).astype(np.uint32)  # by 32 bits: 0, where there is no cache
    width = np.array([x[3] for x in lanes], np.int64)
    out_at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint32)
    copy, source, bad = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, bool)
    has_cache = bool((cache_bits > 0).any())
    base4, mask4 = base[4], mask[4]
    widths, near_at = np.unique(width, return_inverse=True)
    near = np.array([(0, *(max(1, dx + dy * w) for dx, dy in _NEAR)) for w in widths.tolist()], np.int64).reshape(-1)
    near_at = near_at * 121
    alpha_fixed = bool((mask[3] == 0).all())
    alpha_value = (table[base[3]] >> 4).astype(np.uint32) << np.uint32(24)

    def window(p: np.ndarray) -> np.ndarray:
        """32 bits or more from each position."""
        return words.take(p >> 5) >> (p & 31)

    step, live = 0, k
    while live:
        while live and count[live - 1] <= step:
            live -= 1
        if live < LANES:
            break
        n = live
        p, cp = pos[:n], copy[:n]
        w = window(p)
        e = table.take(base[0, :n] + (w & mask[0, :n])).astype(np.int64)
        used = e & 15
        s = e >> 4
        copying = cp > 0
        literal = ~copying & (s < 256)
        w1 = w >> used
        e1 = table.take(base[1, :n] + (w1 & mask[1, :n])).astype(np.int64)
        used1 = used + (e1 & 15)
        # Three codes can take 45 bits: read again before the third.
        w2 = window(p + used1)
        e2 = table.take(base[2, :n] + (w2 & mask[2, :n])).astype(np.int64)
        used2 = used1 + (e2 & 15)
        if alpha_fixed:
            a = alpha_value[:n]
        else:
            e3 = table.take(base[3, :n] + ((w2 >> (e2 & 15)) & mask[3, :n])).astype(np.int64)
            used2 = used2 + (e3 & 15)
            a = (e3 >> 4).astype(np.uint32) << np.uint32(24)
        pixel = a | ((e1 >> 4) << 16 | s << 8 | e2 >> 4).astype(np.uint32)
        here = out_at[:n] + step
        if literal.all():
            p += used2
        else:
            p += np.where(literal, used2, 0)
            rest = np.flatnonzero(~literal & ~copying)
            if len(rest):
                rs = s[rest]
                pos[rest] += used[rest]
                hit = rs >= 280
                if hit.any():
                    r = rest[hit]
                    slot = rs[hit] - 280
                    bad[r] |= slot >= np.where(cache_bits[r] > 0, 1 << cache_bits[r], 0)
                    pixel[r] = cache[cache_at[r] + slot]
                refs = rest[~hit]
                if len(refs):
                    # The length's extra bits and the distance code are 25 bits at most.
                    rs, q = rs[~hit] - 256, pos.take(refs)
                    wide, more = window(q), _EXTRA.take(rs)
                    length = _LEAST.take(rs) + (wide & _MASK.take(rs))
                    e4 = table.take(base4.take(refs) + (wide >> more & mask4.take(refs))).astype(np.int64)
                    q += more + (e4 & 15)
                    e4 >>= 4
                    d = _LEAST.take(e4) + (window(q) & _MASK.take(e4))
                    pos[refs] = q + _EXTRA.take(e4)
                    d = np.where(d > 120, d - 120, near.take(near_at.take(refs) + np.minimum(d, 120)))
                    wrong = (d > step) | (step + length > count.take(refs))
                    if wrong.any():
                        bad[refs] |= wrong
                        length, d = np.where(wrong, 1, length), np.where(wrong, 0, d)
                    copy[refs] = length
                    source[refs] = d
                    copying = copying.copy()
                    copying[refs] = True
            c = np.flatnonzero(copying)
            if len(c):
                pixel[c] = out[np.where(source[c] > 0, here[c] - source[c], here[c])]
                copy[c] -= 1
        out[here] = pixel
        if has_cache:
            cache[cache_at[:n] + (pixel * np.uint32(CACHE_MULTIPLIER) >> shift[:n])] = pixel
        over = p > end[:n]
        if over.any():
            bad[:n] |= over
            np.minimum(p, end[:n], out=p)
        step += 1
    found: list = []
    for i, x in enumerate(lanes):
        a, b = int(out_at[i]), int(out_at[i] + count[i])
        if bad[i]:
            found.append(WebPError("the data end too early or point outside"))
            continue
        if i < live:  # go on alone from here
            bits = Bits(x[2].data, 0)
            skip = int(pos[i]) - 8 * (sum(len(y[2].data) + 16 for y in lanes[:i]))
            bits.byte = skip >> 3
            bits.take(skip & 7)
            done = out[a : a + step].tolist()
            for _ in range(int(copy[i])):
                done.append(done[-int(source[i])])
            try:
                out[a:b] = _scalar_pixels(bits, x[3], x[0], [x[7]], None, 0, x[6], done)
            except WebPError as e:
                found.append(e)
                continue
        found.append(out[a:b])
    return found


# ---------------------------------------------------------------- encoder


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Prefix code lengths for symbol counts, at most ``most`` bits."""
    used = counts.nonzero()[0]
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weight, n = counts[used], len(used)
    while True:
        order = weight.argsort(kind="stable")
        # Two queues: leaves by weight, and inner nodes, which come in order.
        leaves, inner, parent, of_leaf = [*weight[order].tolist(), math.inf], [math.inf] * n, [0] * (n - 1), []
        i = j = 0
        leaf, node = leaves[0], math.inf
        for at in range(n - 1):
            if leaf <= node:
                total = leaf
                of_leaf.append(at)
                i += 1
                leaf = leaves[i]
            else:
                total = node
                parent[j] = at
                j += 1
                node = inner[j]
            if leaf <= node:
                total += leaf
                of_leaf.append(at)
                i += 1
                leaf = leaves[i]
            else:
                total += node
                parent[j] = at
                j += 1
                node = inner[j]
            inner[at] = total
            node = inner[j]
        depth = [1] * (n - 1)  # of a node's children
        for at in range(n - 3, -1, -1):
            depth[at] = depth[parent[at]] + 1
        lengths = [depth[at] for at in of_leaf]
        if max(lengths) <= most:
            out[used[order]] = lengths
            return out
        weight = (weight >> 1) + 1


class _Out:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.size
        self.size += n


# What code lengths are written as, by one byte each: a length, or a run of zeros (codes 17 and
# 18) with its extra bits.
_ITEM = np.array([*range(16), *[17] * 8, *[18] * 128])
_ITEM_EXTRA = np.array([*[0] * 16, *range(8), *range(128)])
_ITEM_MORE = np.array([*[0] * 16, *[3] * 8, *[7] * 128])


class _Runs(dict):
    """Items of a run of zeros and the length behind it, by run * 16 + length."""

    def __missing__(self, key: int) -> bytes:
        left, size = key >> 4, key & 15
        items = bytearray()
        while left >= 11:
            k = min(left, 138)
            items.append(24 + k - 11)
            left -= k
        items += bytes([16 + left - 3] if left >= 3 else left)
        items.append(size)
        self[key] = bytes(items)
        return self[key]


_RUNS = _Runs()


def _write_code(out: _Out, lengths: np.ndarray) -> None:
    used = lengths.nonzero()[0]
    if len(used) <= 1 or (len(used) == 2 and used.max() < 256):
        symbols = used.tolist() or [0]
        if symbols[0] < 256:
            out.put(1, 1)
            out.put(len(symbols) - 1, 1)
            out.put(1, 1)
            for s in symbols:
                out.put(s, 8)
            return
    # Runs of zeros become codes 17 and 18; everything else is written plainly.
    gaps = used - 1
    gaps[1:] -= used[:-1]
    gaps[0] += 1
    items = np.frombuffer(b"".join(map(_RUNS.__getitem__, (gaps << 4 | lengths[used]).tolist())), np.uint8)
    if len(items) < 2:
        items = items.repeat(2)  # the number of items is two at least
    counts = np.bincount(_ITEM[items], minlength=19)
    own = code_lengths(counts, 7)
    codes = canonical(own) if np.count_nonzero(own) > 1 else np.zeros(19, np.int64)
    alone = np.count_nonzero(own) == 1
    order = [int(own[i]) for i in CODE_LENGTH_ORDER]
    top = max(4, max(i + 1 for i, v in enumerate(order) if v))
    out.put(0, 1)
    out.put(top - 4, 4)
    for v in order[:top]:
        out.put(v, 3)
    # The symbols after the last used one are left out.
    need = len(items)
    width = max(1, (need - 2).bit_length() + 1 >> 1)
    out.put(1, 1)
    out.put(width - 1, 3)
    out.put(need - 2, 2 * width)
    size = np.zeros(19, np.int64) if alone else own
    v, n = 0, 0
    for x, k in zip((codes[_ITEM] | _ITEM_EXTRA << size[_ITEM])[items].tolist(), (size[_ITEM] + _ITEM_MORE)[items].tolist(), strict=True):
        v |= x << n
        n += k
    out.put(v, n)


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix code, extra bits' value and their number, for values from 1."""
    code = _LEAST.searchsorted(v, "right") - 1
    return code, v - _LEAST[code], _EXTRA[code]


# Back-references: the longest copy the format takes, how far back one may lie, and how many
# earlier places with the same three pixels are tried, the nearest first.
MOST_COPIED, FARTHEST, CHAIN = 4096, (1 << 20) - 120, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_2, _ODD_3 = (np.uint64(0x9E3779B97F4A7C15**k & (1 << 64) - 1) for k in (2, 3))


@functools.lru_cache(16)
def _near_codes(width: int) -> np.ndarray:
    """The least of the 120 short codes by the distance that it means; 0: none."""
    means = [max(1, dx + dy * width) for dx, dy in _NEAR]
    table = np.zeros(max(means) + 2, np.int64)
    for code in range(120, 0, -1):
        table[means[code - 1]] = code
    return table


@functools.lru_cache(4)
def _powers(bits: int) -> np.ndarray:
    power = np.full((1 << bits) + 1, _ODD)
    power[0] = 1
    return power.cumprod()


def _copies(images: Sequence[np.ndarray], least: int = 3) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Back-references of each flat image: where they begin, their lengths and distances.

    Places that begin with the same three pixels are found for all images by one sort, the
    longest match of up to ``CHAIN`` of them by halving over prefix hashes. A match gives way
    to a longer one a pixel later. What is taken is compared pixel by pixel.
    """
    sizes = np.array([len(x) for x in images])
    flat = np.concatenate(images)
    n = len(flat)
    stops = sizes.cumsum()
    nothing = (np.zeros(0, np.int64),) * 3
    if n < 4:
        return [nothing] * len(images)
    wide = flat.astype(np.uint64)
    power = _powers(n.bit_length())[: n + 1]
    sums = np.zeros(n + 1, np.uint64)
    (wide * power[:-1]).cumsum(out=sums[1:])
    # Places with three pixels are sorted with hashes of them and the image.
    room = np.repeat(stops, sizes) - np.arange(n)
    spot = (room >= 3).nonzero()[0]
    image = np.repeat(np.arange(len(images)), sizes)
    bits = np.uint64(n.bit_length())
    key = wide[:-2] * _ODD + wide[1:-1] * _ODD_2 + wide[2:] * _ODD_3 + image[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    key = key[spot]
    key ^= key >> np.uint64(29)
    key = np.sort(key * _ODD >> bits << bits | spot.astype(np.uint64))
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    key >>= bits
    alike = lambda a, b: (image[a] == image[b]) & (flat[a] == flat[b]) & (flat[a + 1] == flat[b + 1]) & (flat[a + 2] == flat[b + 2])
    again = (key[1:] == key[:-1]).nonzero()[0]
    from_, at = place[again], place[again + 1]
    if not alike(from_, at).all():  # hashes that met by chance: what is found must not depend on them
        place = np.lexsort((spot, flat[spot + 2], flat[spot + 1], flat[spot], image[spot]))
        place = spot[place]
        again = alike(place[:-1], place[1:]).nonzero()[0]
        from_, at = place[again], place[again + 1]
    order = at.argsort()
    from_, at = from_[order], at[order]
    room = np.minimum(room[at], MOST_COPIED)
    before = np.full(n, -1, np.int64)
    before[at] = from_
    far = at - from_
    best = np.where(far <= FARTHEST, 3, 0)
    open_ = best.nonzero()[0]
    for _ in range(CHAIN):
        if not len(open_):
            break
        i, j, most, known = at[open_], from_[open_], room[open_], best[open_]
        # A longer match also holds right behind the longest one so far.
        more = ((known < most) & (flat[np.minimum(i + known, n - 1)] == flat[j + known])).nonzero()[0]
        i_, j_, most_, place = i[more], j[more], most[more], open_[more]
        length, factor = np.full(len(more), 3), power[i_ - j_]
        step = 1 << (int(most_.max()) - 3).bit_length() if len(more) else 0
        while step := step >> 1:
            t = length + step
            ok = (t <= most_).nonzero()[0]
            a, b, t = i_[ok], j_[ok], t[ok]
            ok = ok[sums[a + t] - sums[a] == (sums[b + t] - sums[b]) * factor[ok]]
            length[ok] += step
        longer = length > best[place]
        place = place[longer]
        best[place], far[place] = length[longer], (i_ - j_)[longer]
        # The next one back, where a longer match is still to be had.
        back = before[j]
        from_[open_] = back
        open_ = open_[(best[open_] < most) & (back >= 0) & (i - back <= FARTHEST)]
    use = (best >= least).nonzero()[0]
    places, lengths, taken, free = at[use].tolist(), best[use].tolist(), [], 0
    places.append(-1)
    lengths.append(0)
    for k in range(len(use)):
        i = places[k]
        if i >= free and not (places[k + 1] == i + 1 and lengths[k + 1] > lengths[k] + 1):
            taken.append(k)
            free = i + lengths[k]
    use = use[taken]
    at, best, far = at[use], best[use], far[use]
    inner = np.arange(int(best.sum())) + np.repeat(at - (best.cumsum() - best), best)
    wrong = flat[inner] != flat[inner - np.repeat(far, best)]
    if wrong.any():  # hashes that met by chance
        true = np.bincount(np.repeat(np.arange(len(best)), best)[wrong], minlength=len(best)) == 0
        at, best, far = at[true], best[true], far[true]
    ends = at.searchsorted(stops)
    return [(at[a:b] - start, best[a:b], far[a:b]) for a, b, start in zip([0, *ends[:-1]], ends, stops - sizes, strict=True)]


def _put_image(out: _Out, p: np.ndarray, width: int, cache_bits: int, copies: tuple[np.ndarray, np.ndarray, np.ndarray], main: bool) -> tuple[bytes, int]:
    """What ``out`` holds, then the flat image ``p`` with one group of prefix codes; the bytes, and
    their number of bits."""
    n = len(p)
    begin, copied, far = copies
    kind = np.zeros(n, np.int8)  # 0 literal, 1 cache, 2 copy starts, 3 inside a copy
    if len(begin):
        edge = np.zeros(n + 1, np.int8)
        edge[begin] += 3
        edge[begin + copied] -= 3
        kind = edge.cumsum(dtype=np.int8)[:n]
        kind[begin] = 2
    slot = None
    if cache_bits:
        slot = (p * np.uint32(CACHE_MULTIPLIER) >> np.uint32(32 - cache_bits)).astype(np.uint16)
        order = slot.argsort(kind="stable")  # 16 bits are sorted by digits
        hit = np.zeros(n, bool)
        so, po = slot[order], p[order]
        hit[order[1:]] = (so[1:] == so[:-1]) & (po[1:] == po[:-1])
        kind[hit & (kind == 0)] = 1
    keep = np.flatnonzero(kind != 3)
    k = kind[keep]
    kept = p[keep].astype(np.int64)
    symbol = kept >> 8 & 0xFF
    lit = (k == 0).nonzero()[0]
    kept = kept[lit]
    if cache_bits:
        cached = (k == 1).nonzero()[0]
        symbol[cached] = 280 + slot[keep[cached]].astype(np.int64)
    dist = begin
    if len(begin):
        lp, lv, ln = _prefix(copied)
        symbol[k == 2] = 256 + lp
        near = _near_codes(width)
        short = near[np.minimum(far, len(near) - 1)]
        dist, dv, dn = _prefix(np.where(short > 0, short, far + 120))
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    streams = (symbol, kept >> 16 & 0xFF, kept & 0xFF, kept >> 24, dist)
    lengths = [code_lengths(np.bincount(s, minlength=m)) for s, m in zip(streams, sizes, strict=True)]
    many = [np.count_nonzero(x) > 1 for x in lengths]  # a single symbol takes no bits
    codes = [canonical(x) if m else x for x, m in zip(lengths, many, strict=True)]
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)  # one group of codes
    for x in lengths:
        _write_code(out, x)
    # Per kept pixel: green code, then red, blue and alpha of a literal, or the extra
    # bits of a copy's length, its distance code and that one's extra bits. Green, red
    # and blue are one field of at most 45 bits, alpha and the distance others; each is added
    # to the two 64-bit words that it touches. Fields never share bits, so sums are unions.
    value, size = np.zeros(len(keep), np.int64), np.zeros(len(keep), np.int64)
    if many[0]:
        value, size = codes[0][symbol], lengths[0][symbol]
    tail, tail_size = np.zeros(len(lit), np.int64), np.zeros(len(lit), np.int64)
    for i in (1, 2):
        if many[i]:
            tail |= codes[i][streams[i]] << tail_size
            tail_size += lengths[i][streams[i]]
    value[lit] |= tail << size[lit]
    size[lit] += tail_size
    whole = size
    if len(begin):
        references = (k == 2).nonzero()[0]
        value[references] |= lv << size[references]
        size[references] += ln
        if many[4]:
            dv = codes[4][dist] | dv << lengths[4][dist]
            dn = dn + lengths[4][dist]
        whole = size.copy()
        whole[references] += dn
    if many[3]:
        whole = size.copy() if whole is size else whole
        whole[lit] += lengths[3][streams[3]]
    head = out.value.to_bytes((out.size + 7) // 8, "little")
    place = out.size + whole.cumsum() - whole
    total = out.size + int(whole.sum())
    words = np.zeros(total // 64 + 3, np.uint64)
    words.view(np.uint8)[: len(head)] = np.frombuffer(head, np.uint8)
    fields = [(value, place)]
    if many[3]:
        fields.append((codes[3][streams[3]], place[lit] + size[lit]))
    if len(begin) and dn.any():
        fields.append((dv, place[references] + size[references]))
    for v, at in fields:
        v, by = v.astype(np.uint64), (at & 63).astype(np.uint64)
        at >>= 6
        np.add.at(words, at, v << by)
        np.add.at(words, at + 1, v >> np.uint64(1) >> (np.uint64(63) - by))
    body = words.astype("<u8", copy=False).view(np.uint8)
    return body[: (total + 7) // 8].tobytes(), total


def _put_small(out: _Out, p: np.ndarray) -> None:
    """A palette, or the image of a transform's tiles."""
    data, size = _put_image(_Out(), np.ascontiguousarray(p).reshape(-1), p.shape[1], 0, (np.zeros(0, np.int64),) * 3, False)
    out.put(int.from_bytes(data, "little"), size)


# ---------------------------------------------------------------- transforms, forwards

TILE_BITS = 4
DIRECT, GREEN, SPATIAL, SPATIAL_GREEN, COLOUR, SPATIAL_COLOUR, PALETTED = range(7)


def _channels(a: np.ndarray) -> np.ndarray:
    """uint32 ARGB -> (4, ...) uint8 in R, G, B, A order."""
    return np.stack([(a >> np.uint32(s)).astype(np.uint8) for s in (16, 8, 0, 24)])


def _pixels(c: np.ndarray, alpha: int = 255) -> np.ndarray:
    """The inverse; ``alpha`` is that of three samples."""
    r, g, b, *a = (x.astype(np.uint32) for x in c)
    return (a[0] if a else np.uint32(alpha)) << 24 | r << 16 | g << 8 | b


def _weighed(n: np.ndarray) -> np.ndarray:
    """Counts times their logarithms, in 256ths."""
    return _WEIGHED.take(n) if n.max(initial=0) < len(_WEIGHED) else np.rint(256 * n * np.log2(np.maximum(n, 1))).astype(np.int64)


_WEIGHED = np.zeros(0, np.int64)
_WEIGHED = _weighed(np.arange(1 << 12))


class _Stack:
    """Images of one width on top of each other, cut into tiles image by image."""

    def __init__(self, images: Sequence[np.ndarray]):
        self.width = images[0].shape[1]
        self.rows = np.array([len(x) for x in images])
        self.start = self.rows.cumsum() - self.rows
        self.c = _channels(np.concatenate(images))
        if (self.c[3] == 255).all():  # opaque: nothing to tell of alpha, before or after a transform
            self.c = self.c[:3]
        side = 1 << TILE_BITS
        self.columns = np.arange(0, self.width, side)
        tall = _up(self.rows, TILE_BITS)
        self.tile_start = tall.cumsum() - tall  # of an image, in rows of tiles
        self.tall = tall
        nth = np.arange(int(tall.sum())) - np.repeat(self.tile_start, tall)
        self.bands = np.repeat(self.start, tall) + nth * side
        self.band_of = np.repeat(np.arange(len(self.bands)), np.diff([*self.bands, int(self.rows.sum())]))
        self.column_of = np.arange(self.width) >> TILE_BITS
        self.image_of = np.repeat(np.arange(len(images)), self.rows * self.width)

    def per_tile(self, x: np.ndarray) -> np.ndarray:
        """Sums; those of a tile's column must fit the samples' type."""
        return np.add.reduceat(np.add.reduceat(x, self.bands, axis=0, dtype=x.dtype), self.columns, axis=1, dtype=np.int64)

    def spread(self, tiles: np.ndarray) -> np.ndarray:
        return tiles[self.band_of][:, self.column_of]

    def rows_of(self, i: int) -> slice:
        return slice(int(self.start[i]), int(self.start[i] + self.rows[i]))

    def tiles_of(self, i: int) -> slice:
        return slice(int(self.tile_start[i]), int(self.tile_start[i] + self.tall[i]))

    def bits(self, c: Sequence[np.ndarray]) -> np.ndarray:
        """Per image: entropy of the samples, and some bits for each symbol of a code, in 256ths.
        Whole numbers, as equal images must get equal sums in any company."""
        n, total = len(self.rows), np.zeros(len(self.rows), np.int64)
        pixels = self.rows * self.width
        for x in c:
            counts = np.bincount(self.image_of * 256 + x.reshape(-1), minlength=256 * n).reshape(n, 256)
            total += _weighed(pixels) - _weighed(counts).sum(1) + 1024 * np.count_nonzero(counts, axis=1)
        return total


def _guesses(c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each predictor's view of every pixel but those of first rows and columns."""
    left, top = np.zeros_like(c), np.zeros_like(c)
    left[..., 1:], top[:, 1:] = c[..., :-1], c[:, :-1]
    corner, right = np.zeros_like(c), np.empty_like(c)
    corner[..., 1:] = top[..., :-1]
    right[..., :-1], right[..., -1] = top[..., 1:], c[..., 0]
    half = lambda a, b: (a & b) + ((a ^ b) >> 1)
    yield 1, left
    yield 2, top
    yield 3, right
    yield 4, corner
    yield 5, half(half(left, right), top)
    left_corner, top_right = half(left, corner), half(top, right)
    yield 6, left_corner
    mean = half(left, top)
    yield 7, mean
    yield 8, half(corner, top)
    yield 9, top_right
    yield 10, half(left_corner, top_right)
    a, b, q, m = (x.astype(np.int16) for x in (left, top, corner, mean))
    nearer = np.abs(b - q).sum(0) < np.abs(a - q).sum(0)
    yield 11, np.where(nearer, left, top)
    yield 12, (a + b - q).clip(0, 255).astype(np.uint8)
    d = m - q
    yield 13, (m + ((d + (d < 0)) >> 1)).clip(0, 255).astype(np.uint8)
    black = np.zeros_like(c)
    black[3:] = 255
    yield 0, black


def _predicted(s: _Stack) -> tuple[np.ndarray, np.ndarray]:
    """What is left of the samples after each tile's best predictor, and the predictors."""
    c, first = s.c, s.start
    rest, modes, least = np.empty_like(c), None, None
    for mode, guess in _guesses(c):
        r = c - guess
        size = np.minimum(r, np.uint8(0) - r).sum(0, dtype=np.uint16)
        size[first], size[:, 0] = 0, 0  # no predictor's; above a first row is another image
        cost = s.per_tile(size)
        if least is None:
            rest, modes, least = r, np.full(cost.shape, mode), cost
        elif (better := cost < least).any():
            np.copyto(rest, r, where=s.spread(better))
            modes[better], least = mode, np.minimum(cost, least)
    # First rows look left, first columns up, the first pixel at opaque black.
    rest[:, 1:, 0] = c[:, 1:, 0] - c[:, :-1, 0]
    rest[:, first, 1:] = c[:, first, 1:] - c[:, first, :-1]
    rest[:, first, 0] = c[:, first, 0] - np.array([0, 0, 0, 255], np.uint8)[: len(c), None]
    return rest, modes


def _decorrelated(s: _Stack, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples less what each tile's regression tells of red from green, and of blue from
    green and red; the tiles."""
    red, green, blue = (c[i].view(np.int8).astype(np.int32) for i in (0, 1, 2))
    count = s.per_tile(np.ones_like(green))

    def slope(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sx, sy = s.per_tile(x), s.per_tile(y)
        spread = count * s.per_tile(x * x) - sx * sx
        return np.rint(32 * (count * s.per_tile(x * y) - sx * sy) / np.maximum(spread, 1)).clip(-128, 127).astype(np.int32)

    to_red, to_blue = slope(green, red), slope(green, blue)
    blue = blue - (s.spread(to_blue) * green >> 5)
    red_to_blue = slope(red, blue)
    out = c.copy()
    out[2] = (blue - (s.spread(red_to_blue) * red >> 5)).astype(np.uint8)
    out[0] = (red - (s.spread(to_red) * green >> 5)).astype(np.uint8)
    tiles = [(x & 0xFF).astype(np.uint32) for x in (red_to_blue, to_blue, to_red)]
    return out, np.uint32(0xFF000000) | tiles[0] << 16 | tiles[1] << 8 | tiles[2]


def _less_green(c: np.ndarray) -> np.ndarray:
    return np.stack([c[0] - c[1], c[1], c[2] - c[1], *c[3:]])


def _palette_bits(s: _Stack) -> np.ndarray:
    """Per image: entropy of whole pixels and their colours' bits; infinite beyond 256 colours."""
    # Images with over 256 hashes of colours are told without a sort.
    p, out = _pixels(s.c).reshape(-1), np.full(len(s.rows), np.inf)
    met = np.zeros((len(s.rows), 1 << 12), bool)
    met[s.image_of, p * np.uint32(CACHE_MULTIPLIER) >> np.uint32(20)] = True
    few = np.count_nonzero(met, axis=1) <= 256
    if few.any():
        own = few[s.image_of]
        key = np.sort(s.image_of[own].astype(np.uint64) << np.uint64(32) | p[own])
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        image = (key[at] >> np.uint64(32)).astype(np.int64)
        colours = np.bincount(image, minlength=len(out))
        told = _weighed(s.rows * s.width) - np.bincount(image, weights=_weighed(np.diff([*at, len(key)])), minlength=len(out))
        out = np.where(few & (colours <= 256), told + 256 * 20 * colours, np.inf)
    return out


def _variants(images: Sequence[np.ndarray]) -> list[tuple[int, list[tuple], np.ndarray] | None]:
    """For each image (all of one width): the transforms that promise the fewest bits, and the
    pixels that they leave; none where plain pixels do."""
    s = _Stack(images)
    tiles = s.tall * len(s.columns)
    rest, modes = _predicted(s)
    plain, spatial = _decorrelated(s, s.c), _decorrelated(s, rest)
    made = {DIRECT: s.c, GREEN: _less_green(s.c), SPATIAL: rest, SPATIAL_GREEN: _less_green(rest), COLOUR: plain[0], SPATIAL_COLOUR: spatial[0]}
    # Green is the same with and without what is told of red and blue by it.
    greens = {False: s.bits(s.c[1:2]), True: s.bits(rest[1:2])}
    bits = [s.bits([made[v][0], *made[v][2:]]) + greens[v in (SPATIAL, SPATIAL_GREEN, SPATIAL_COLOUR)] for v in range(PALETTED)]
    bits.append(_palette_bits(s))
    for v in (SPATIAL, SPATIAL_GREEN, SPATIAL_COLOUR):
        bits[v] += 256 * (100 + 3 * tiles)
    for v, t in ((COLOUR, tiles), (SPATIAL_COLOUR, tiles)):
        bits[v] += 256 * (150 + 16 * t)
    found: list = []
    for i, v in enumerate(np.argmin(bits, axis=0).tolist()):
        if v == DIRECT:
            found.append(None)
            continue
        if v == PALETTED:
            found.append((v, *_paletted(images[i])))
            continue
        steps: list[tuple] = []
        if v in (SPATIAL, SPATIAL_GREEN, SPATIAL_COLOUR):
            steps.append((PREDICTOR, np.uint32(0xFF000000) | modes[s.tiles_of(i)].astype(np.uint32) << np.uint32(8)))
        if v in (GREEN, SPATIAL_GREEN):
            steps.append((SUBTRACT_GREEN,))
        if v in (COLOUR, SPATIAL_COLOUR):
            steps.append((CROSS_COLOUR, (plain if v == COLOUR else spatial)[1][s.tiles_of(i)]))
        found.append((v, steps, _pixels(made[v][:, s.rows_of(i)], 0 if steps[0][0] == PREDICTOR else 255)))
    return found


def _paletted(a: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """The palette as steps from colour to colour; indices, up to eight a pixel."""
    colours, index = np.unique(a, return_inverse=True)
    index, n = index.reshape(a.shape).astype(np.uint32), len(colours)
    c = _channels(colours)
    c[:, 1:] -= c[:, :-1].copy()
    pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    if pack:
        per, depth = 1 << pack, 8 >> pack
        index = np.pad(index, ((0, 0), (0, -a.shape[1] % per))).reshape(len(a), -1, per)
        index = (index << (np.arange(per, dtype=np.uint32) * np.uint32(depth))).sum(2, dtype=np.uint32)
    return [(PALETTE, _pixels(c)[None, :])], np.uint32(0xFF000000) | index << np.uint32(8)


def _put_steps(out: _Out, steps: list[tuple]) -> None:
    for kind, *tiles in steps:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == PALETTE:
            out.put(tiles[0].shape[1] - 1, 8)
        elif tiles:
            out.put(TILE_BITS - 2, 3)
        if tiles:
            _put_small(out, tiles[0])
    out.put(0, 1)


def _file(argb: np.ndarray, steps: list[tuple], p: np.ndarray, copies: tuple, cache_bits: int | None) -> bytes:
    """A WebP file of the image ``argb`` that the ``steps`` turn into ``p``."""
    height, width = argb.shape
    if cache_bits is None:
        cache_bits = 0 if p.size < 512 or steps and steps[0][0] == PALETTE else 7
    out = _Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int((argb < 0xFF000000).any()), 1)
    out.put(0, 3)
    _put_steps(out, steps)
    data, _ = _put_image(out, p.reshape(-1), p.shape[1], cache_bits, copies, True)
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + (4 + 8 + len(data) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + pad


#: Pixels of the images whose transforms and copies are looked for at once.
TOGETHER = 1 << 15


def encode_many(images: Sequence[np.ndarray], cache_bits: int | None = None, least_run: int = 3) -> list[bytes]:
    """Like ``encode`` for each image."""
    for x in images:
        if not 0 < x.shape[1] <= MAX_SIDE or not 0 < x.shape[0] <= MAX_SIDE:
            raise ValueError("the image is empty or too large")
    out: list[bytes] = [b""] * len(images)
    group: list[int] = []
    size = 0
    # Images of a group have one width, and alpha or not.
    kinds = [(x.shape[1], bool((x < 0xFF000000).any())) for x in images]
    order = sorted(range(len(images)), key=kinds.__getitem__)
    for k, i in enumerate(order):
        group.append(i)
        size += images[i].size
        if size < TOGETHER and k + 1 < len(order) and kinds[order[k + 1]] == kinds[i]:
            continue
        here = [images[j] for j in group]
        for j, copies, other in zip(group, _copies([np.ascontiguousarray(x).reshape(-1) for x in here], least_run), _variants(here), strict=True):
            out[j] = _file(images[j], [], images[j], copies, cache_bits)
            if other is not None:
                _, steps, p = other
                tried = _file(images[j], steps, p, _copies([p.reshape(-1)], least_run)[0], cache_bits)
                out[j] = min(out[j], tried, key=len)
        group, size = [], 0
    return out


def encode(argb: np.ndarray, cache_bits: int | None = None, least_run: int = 3) -> bytes:
    """A WebP file for (height, width) uint32 ARGB pixels."""
    return encode_many([argb], cache_bits, least_run)[0]


# ---------------------------------------------------------------- operators


def decode_column(df: DataFrame, media_col: str, out: str = "pixels") -> DataFrame:
    """Add ``out``: struct(width, height, rgba binary, error). Null media give
    null; bytes that are no lossless WebP give an error and no pixels."""

    @F.arrow_udf("struct<width:int,height:int,rgba:binary,error:string>")
    def read(media: pa.Array) -> pa.Array:
        files = media.to_pylist()
        given = [x for x in files if x is not None]
        found = iter(decode_many(given))
        rows = []
        for x in files:
            y = None if x is None else next(found)
            rows.append(None if x is None else {"width": None, "height": None, "rgba": None, "error": str(y)} if isinstance(y, WebPError) else {"width": y.shape[1], "height": y.shape[0], "rgba": y.tobytes(), "error": None})
        return pa.array(rows, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("error", pa.string())]))

    return df.withColumn(out, read(F.col(media_col)))


ROW = 192  # bytes: 64 pixels of three samples


def text_image(payload: bytes) -> np.ndarray:
    """A payload (a multiple of ROW bytes) as opaque RGB pixels. Up to 16384
    rows of 64 pixels; longer ones get wider rows, the last filled with zeros."""
    rows = len(payload) // ROW
    wide = -(-rows // MAX_SIDE)
    if 64 * wide > MAX_SIDE:
        raise ValueError("the text is too long for one image")
    data = payload + bytes(-rows % wide * ROW)
    rgb = np.frombuffer(data, np.uint8).reshape(-1, 64 * wide, 3).astype(np.uint32)
    return np.uint32(0xFF000000) | rgb[..., 0] << 16 | rgb[..., 1] << 8 | rgb[..., 2]


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def _feature(y: np.ndarray) -> str:
    """Shape, mean of each sample and mean absolute step between neighbours."""
    planes = np.moveaxis(y[..., :3], -1, 0).astype(np.int16, order="C")  # whole rows of one sample
    steps = np.abs(planes[..., 1:] - planes[..., :-1])
    means = [x.sum(axis=(1, 2), dtype=np.int64) / (x.shape[1] * x.shape[2]) for x in (planes, steps)]
    return f"{y.shape[1]}x{y.shape[0]};" + ",".join(f"{x:.4f}" for m in means for x in m)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text as a lossless WebP image, decode the stored bytes
    and describe what was read back.

    Returns id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last
    16 bytes), media_bytes, media_sha256, feature (shape, mean of each sample
    and mean absolute step between neighbours, from the decoded pixels). Map
    only; memory is bounded by a slice of a batch.

    Defined results: a null text counts as empty, which is one row of spaces;
    equal texts give equal values; an empty table gives no rows; other columns
    are ignored; a text beyond about 800 MB, the format's largest image, fails.
    """
    kept = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = kept.select(id_col).schema
    for name, kind in (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 24 << 20):
                rows = []
                texts = piece.column(1).to_pylist()
                loads = [padded(t) for t in texts]
                media = encode_many([text_image(x) for x in loads])
                sizes = [len(x) for x in loads]
                del loads
                for t, size, m, y in zip(texts, sizes, media, decode_many(media), strict=True):
                    if isinstance(y, WebPError):
                        raise y
                    flat = y[..., :3].reshape(-1)
                    back = flat[:size].tobytes()
                    feature = _feature(y)
                    rows.append((len((t or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x) for x in cols)], names=schema.names)

    return kept.mapInArrow(run, schema)
