"""The lossless bitstream: a per-image kernel for what is bit-serial, numpy for what is not, faults as data."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .demux import Limits, need, parse
from .errors import ImageError, category

# The order in which code lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# The 120 short distances as (dx, dy).
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, COLOR, SUBTRACT_GREEN, PALETTE = range(4)


class Bits:
    """Least significant bit first; reading past the end is TruncatedBitstream and takes nothing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = bytes(data), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def drop(self, n: int) -> None:
        need(self.at + n <= self.end, "TruncatedBitstream")
        self.at += n

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.drop(n)
        return v


class BitWriter:
    """Collects fields, least significant bit first; zero bits fill the last byte. Beyond `most` bytes: OutputTooLarge."""

    def __init__(self, most: int | None = None):
        self.value, self.n, self.out, self.most = 0, 0, bytearray(), most

    def put(self, value: int, n: int) -> BitWriter:
        self.value |= (value & ((1 << n) - 1)) << self.n
        self.n += n
        need(self.most is None or 8 * len(self.out) + self.n <= 8 * self.most, "OutputTooLarge")
        if self.n >= 512:
            whole = self.n // 8
            self.out += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value, self.n = self.value >> 8 * whole, self.n - 8 * whole
        return self

    def done(self) -> bytes:
        return bytes(self.out) + self.value.to_bytes((self.n + 7) // 8, "little")


class Budget:
    """Bytes that decoding one image may take: pixels by the format's rule, prefix tables at four bytes an entry."""

    def __init__(self, most: int):
        self.left = most

    def take(self, n: int) -> None:
        self.left -= n
        need(self.left >= 0, "AllocationLimitExceeded")


#: Pixels beside the image itself that side images may hold.
SIDE_PIXELS = 257
#: Pixels that a transform is undone on at a time.
CHUNK_PIXELS = 1 << 20


class Code:
    """A canonical prefix code as one table over its longest code; a lone symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        need(bool(used), "InvalidHuffmanTree")
        self.only = used[0][1] if len(used) == 1 else None
        if self.only is not None:
            need(used[0][0] == 1, "InvalidHuffmanTree")
            return
        need(sum(1 << (15 - n) for n, _ in used) == 1 << 15, "InvalidHuffmanTree")
        self.width = max(used)[0]
        self.table: list[tuple[int, int]] = [(0, 0)] * (1 << self.width)
        code, last = 0, 0
        for n, s in sorted(used):
            code <<= n - last
            last = n
            start = int(f"{code:0{n}b}"[::-1], 2)
            self.table[start :: 1 << n] = [(s, n)] * (1 << (self.width - n))
            code += 1

    @property
    def size(self) -> int:
        return 1 if self.only is not None else len(self.table)

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        s, n = self.table[bits.peek(self.width)]
        bits.drop(n)
        return s


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            need(s < alphabet, "InvalidHuffmanTree")
            lengths[s] = 1
        return Code(lengths)
    own = [0] * 19
    for s in LENGTH_ORDER[: bits.read(4) + 4]:
        own[s] = bits.read(3)
    code, left = Code(own), alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        need(left <= alphabet, "InvalidHuffmanTree")
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        fill, base, extra = ((before, 3, 2), (0, 3, 3), (0, 11, 7))[s - 16]
        n = base + bits.read(extra)
        need(at + n <= alphabet, "InvalidHuffmanTree")
        lengths[at : at + n] = [fill] * n
        at += n
    return Code(lengths)


def prefix_value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def read_group(bits: Bits, sizes: tuple[int, ...], budget: Budget | None) -> list[Code]:
    group = [read_code(bits, n) for n in sizes]
    if budget:
        budget.take(4 * sum(c.size for c in group))
    return group


def read_pixels(bits: Bits, w: int, h: int, main: bool, counts: dict | None = None, budget: Budget | None = None, keep: bool = True) -> array:
    """An entropy-coded image as ARGB values, row by row. keep: whether its pixels are wanted, or only its validity and counts."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        need(1 <= cache_bits <= 11, "InvalidVP8LImageData")
    block, groups_of, n_groups = 0, None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        bw, bh = (w + (1 << block) - 1) >> block, (h + (1 << block) - 1) >> block
        groups_of = [(p >> 8) & 0xFFFF for p in read_pixels(bits, bw, bh, False, budget=budget)]
        n_groups = max(groups_of) + 1
    cache = [0] * (1 << cache_bits) if cache_bits else None
    sizes = (256 + 24 + (len(cache) if cache else 0), 256, 256, 256, 40)
    groups = [read_group(bits, sizes, budget) for _ in range(n_groups)]
    out = array("I")
    total, done, shift = w * h, 0, 32 - cache_bits
    literals = copies = hits = 0

    while done < total:
        group = groups[groups_of[(done // w >> block) * bw + (done % w >> block)] if groups_of else 0]
        s = group[0].read(bits)
        if s < 256:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            done += 1
            literals += 1
            if keep:
                v = a << 24 | r << 16 | s << 8 | b
                out.append(v)
                if cache:
                    cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
        elif s < 280:
            n = prefix_value(bits, s - 256)
            need(done + n <= total, "InvalidVP8LImageData")
            d = distance_of(prefix_value(bits, group[4].read(bits)), w)
            need(d <= done, "InvalidVP8LImageData")
            done += n
            copies += 1
            if keep:
                piece = out[-d : len(out) - d + n] if d >= n else (out[-d:] * (n // d + 1))[:n]  # it may overlap itself
                out.extend(piece)
                if cache:
                    for v in piece:
                        cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
        else:
            need(cache is not None and s - 280 < len(cache), "InvalidVP8LImageData")
            done += 1
            hits += 1
            if keep:
                out.append(cache[s - 280])
    if counts is not None:
        counts |= {"pixels": total, "literals": literals, "copies": copies, "cache_hits": hits}
    return out


def planes(argb: np.ndarray) -> np.ndarray:
    """(..., 4) of a, r, g, b."""
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], axis=-1)


def join(p: np.ndarray) -> np.ndarray:
    p = p & 255
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def undo_green(img: np.ndarray) -> np.ndarray:
    p = planes(img)
    p[..., 1] += p[..., 2]
    p[..., 3] += p[..., 2]
    return join(p)


def undo_color(img: np.ndarray, element: np.ndarray, bits: int, first: int = 0) -> np.ndarray:
    h, w = img.shape
    e = planes(element[np.arange(first, first + h)[:, None] >> bits, np.arange(w)[None] >> bits])
    s8 = lambda v: ((v & 255) ^ 128) - 128
    p = planes(img)
    delta = lambda k, v: s8(e[..., k]) * s8(v) >> 5
    p[..., 1] = (p[..., 1] + delta(3, p[..., 2])) & 255
    p[..., 3] = (p[..., 3] + delta(2, p[..., 2]) + delta(1, p[..., 1])) & 255
    return join(p)


def undo_palette(img: np.ndarray, palette: np.ndarray, wb: int, width: int) -> np.ndarray:
    x = np.arange(width)
    green = img[:, x >> wb] >> 8 & 255
    index = green >> ((x & ((1 << wb) - 1)) * (8 >> wb)) & ((1 << (8 >> wb)) - 1)
    return np.where(index < len(palette), palette[np.minimum(index, len(palette) - 1)], 0)


ODD, EVEN, HALVES = 0xFF00FF00, 0x00FF00FF, 0xFEFEFEFE
BLACK = 0xFF000000


def _add(a, b):
    """Channel by channel modulo 256, on packed pixels: whole numbers or arrays of 32 bits."""
    return (((a & ODD) + (b & ODD)) & ODD) | (((a & EVEN) + (b & EVEN)) & EVEN)


def _mean(a, b):
    return (((a ^ b) & HALVES) >> 1) + (a & b)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _packed(values) -> int:
    out = 0
    for v in values:
        out = out << 8 | (0 if v < 0 else 255 if v > 255 else v)
    return out


def _select(left: int, top: int, corner: int) -> int:
    l, t, c = _channels(left), _channels(top), _channels(corner)
    # how far left + top - corner is from either
    return left if sum(abs(x - z) for x, z in zip(t, c, strict=True)) < sum(abs(x - z) for x, z in zip(l, c, strict=True)) else top


def _plus_gradient(left: int, top: int, corner: int) -> int:
    return _packed(x + y - z for x, y, z in zip(_channels(left), _channels(top), _channels(corner), strict=True))


def _plus_half(left: int, top: int, corner: int) -> int:
    return _packed(m + int((m - z) / 2) for m, z in zip(_channels(_mean(left, top)), _channels(corner), strict=True))


#: By mode: left, top, right, corner -> prediction.
RUNNING: dict[int, Callable[[int, int, int, int], int]] = {
    0: lambda l, t, r, c: BLACK, 1: lambda l, t, r, c: l, 2: lambda l, t, r, c: t, 3: lambda l, t, r, c: r, 4: lambda l, t, r, c: c, 5: lambda l, t, r, c: _mean(_mean(l, r), t), 6: lambda l, t, r, c: _mean(l, c),
    7: lambda l, t, r, c: _mean(l, t), 8: lambda l, t, r, c: _mean(c, t), 9: lambda l, t, r, c: _mean(t, r), 10: lambda l, t, r, c: _mean(_mean(l, c), _mean(t, r)),
    11: lambda l, t, r, c: _select(l, t, c), 12: lambda l, t, r, c: _plus_gradient(l, t, c), 13: lambda l, t, r, c: _plus_half(l, t, c),
}
#: The modes that only need the row above: top, right, corner -> prediction, on arrays.
ABOVE: dict[int, Callable] = {0: lambda t, r, c: np.full_like(t, BLACK), 2: lambda t, r, c: t, 3: lambda t, r, c: r, 4: lambda t, r, c: c, 8: lambda t, r, c: _mean(c, t), 9: lambda t, r, c: _mean(t, r)}
#: From so many pixels on, a stretch of one mode is worth an array.
STRETCH = 48


def _running_sum(first: int, residual: np.ndarray) -> np.ndarray:
    """Each pixel the sum of `first` and the residuals up to it."""
    sums = np.cumsum(planes(residual), axis=0) + np.array(_channels(first))
    return join(sums)


def undo_predictor(img: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Row by row, stretch by stretch of one mode: at once where the row above decides, else in a running loop."""
    h, w = img.shape
    need(int((modes >> 8 & 255).max()) < 14, "InvalidVP8LTransform")
    out = np.empty((h, w), np.uint32)
    out[0, 0] = _add(int(img[0, 0]), BLACK)
    out[0, 1:] = _running_sum(int(out[0, 0]), img[0, 1:].astype(np.int64))
    up, stretches = out[0].tolist(), []
    for y in range(1, h):
        if y == 1 or y & ((1 << bits) - 1) == 0:
            row_modes, stretches = (modes[y >> bits] >> 8 & 255).tolist(), []
            for k, mode in enumerate(row_modes):
                end = min(w, (k + 1) << bits)
                if stretches and stretches[-1][0] == mode:
                    stretches[-1][2] = end
                else:
                    stretches.append([mode, max(1, k << bits), end])
        residual = img[y].tolist()
        done = [_add(residual[0], up[0])]
        right = [*up[1:], done[0]]  # past the right edge stands the first pixel of this row
        for mode, a, b in stretches:
            if b - a >= STRETCH and (mode in ABOVE or mode == 1):
                part = img[y, a:b].astype(np.int64)
                some = (np.array(v[i : i + b - a], np.int64) for v, i in ((up, a), (right, a), (up, a - 1)))
                done += (_running_sum(done[-1], part) if mode == 1 else _add(part, ABOVE[mode](*some))).tolist()
                continue
            guess, left = RUNNING[mode], done[-1]
            for v, t, r, c in zip(residual[a:b], up[a:b], right[a:b], up[a - 1 : b - 1], strict=True):
                p = guess(left, t, r, c)
                left = (((v & ODD) + (p & ODD)) & ODD) | (((v & EVEN) + (p & EVEN)) & EVEN)
                done.append(left)
        out[y] = up = done
    return out


def by_rows(f: Callable[..., np.ndarray], img: np.ndarray, width: int, *arguments) -> np.ndarray:
    """Undoes a transform on a few rows at a time: f(rows, first row, *arguments)."""
    out = np.empty((img.shape[0], width), np.uint32)
    step = max(1, CHUNK_PIXELS // width)
    for y in range(0, img.shape[0], step):
        out[y : y + step] = f(img[y : y + step].astype(np.int64), y, *arguments)
    return out


def decode(payload: bytes, headerless: tuple[int, int] | None = None, counts: dict | None = None, budget: Budget | None = None, keep: bool = True) -> np.ndarray | None:
    """The image as an (h, w) array of ARGB values. keep: False reads and checks the whole stream for its counts alone."""
    bits = Bits(payload)
    if headerless:
        w, h = headerless
    else:
        need(len(payload) >= 5 and payload[0] == 0x2F, "InvalidVP8LHeader")
        bits.drop(8)
        w, h = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        need(bits.read(3) == 0, "InvalidVP8LHeader")
    undo, seen, width = [], set(), w
    while bits.read(1):
        kind = bits.read(2)
        need(kind not in seen, "InvalidVP8LTransform")
        seen.add(kind)
        if kind in (PREDICTOR, COLOR):
            b = bits.read(3) + 2
            bw, bh = (width + (1 << b) - 1) >> b, (h + (1 << b) - 1) >> b
            side = np.array(read_pixels(bits, bw, bh, False, budget=budget), np.int64).reshape(bh, bw)
            if kind == PREDICTOR:
                need(int((side >> 8 & 255).max()) < 14, "InvalidVP8LTransform")
                undo.append(lambda img, side=side, b=b: undo_predictor(img, side, b))
            else:
                undo.append(lambda img, side=side, b=b: by_rows(lambda rows, y: undo_color(rows, side, b, y), img, img.shape[1]))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda img: by_rows(lambda rows, y: undo_green(rows), img, img.shape[1]))
        else:
            n = bits.read(8) + 1
            colors = join(np.cumsum(planes(np.array(read_pixels(bits, n, 1, False, budget=budget), np.int64)), axis=0))
            wb = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda img, colors=colors, wb=wb, wide=width: by_rows(lambda rows, y: undo_palette(rows, colors, wb, wide), img, wide))
            width = (width + (1 << wb) - 1) >> wb
    pixels = read_pixels(bits, width, h, True, counts, budget, keep)
    if not keep:
        return None
    img = np.frombuffer(pixels, np.uint32).reshape(h, width)
    for f in reversed(undo):
        img = f(img)
    return img


def summary(payload: bytes) -> dict:
    """Pixels, literals, copies and cache hits of a stream, or its error, without any pixel of the main image."""
    counts: dict = {}
    try:
        decode(payload, counts=counts, keep=False)
    except ImageError as e:
        return {"error": e.name}
    return counts


def swizzle(img: np.ndarray, order: str) -> bytes:
    """Pixels as bytes; order is rgb, rgba, bgra or argb."""
    return np.stack([img >> np.uint32({"a": 24, "r": 16, "g": 8, "b": 0}[c]) & np.uint32(255) for c in order], axis=-1).astype(np.uint8).tobytes() if img.dtype == np.uint32 else planes(img)[..., ["argb".index(c) for c in order]].astype(np.uint8).tobytes()


def write_code(out: BitWriter, alphabet: int) -> None:
    """A normal code that gives the first 256 symbols their own 8 bits."""
    out.put(0, 1).put(12 - 4, 4)
    for s in LENGTH_ORDER[:12]:
        out.put(1 if s in (0, 8) else 0, 3)
    out.put(0, 1)
    for s in range(alphabet):
        out.put(1 if s < 256 else 0, 1)


def write_image(img: np.ndarray, subtract_green: bool = False, alpha: bool = True) -> bytes:
    """A plain but complete stream: every pixel a literal."""
    h, w = img.shape
    out = BitWriter().put(0x2F, 8).put(w - 1, 14).put(h - 1, 14).put(int(alpha), 1).put(0, 3)
    p = planes(np.asarray(img, np.int64))
    if subtract_green:
        out.put(1, 1).put(SUBTRACT_GREEN, 2)
        p[..., 1], p[..., 3] = (p[..., 1] - p[..., 2]) & 255, (p[..., 3] - p[..., 2]) & 255
    out.put(0, 1).put(0, 1).put(0, 1)
    for n in (280, 256, 256, 256):
        write_code(out, n)
    out.put(1, 1).put(0, 1).put(0, 1).put(0, 1)  # distances: the lone symbol 0
    reverse = [int(f"{v:08b}"[::-1], 2) for v in range(256)]
    for a, r, g, b in p.reshape(-1, 4).tolist():
        out.put(reverse[g] | reverse[r] << 8 | reverse[b] << 16 | reverse[a] << 24, 32)
    return out.done()


def _near_codes(width: int) -> dict[int, int]:
    """The short code of each distance that has one."""
    out: dict[int, int] = {}
    for code in range(1, len(NEAR) + 1):
        out.setdefault(distance_of(code, width), code)
    return out


def prefixed(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, how many) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v - ((2 + half) << (top - 1)), top - 1


def even_lengths(used: list[int], alphabet: int) -> list[int]:
    """Code lengths of a complete code in which all used symbols are about as long."""
    out, n = [0] * alphabet, len(used)
    if n == 1:
        out[used[0]] = 1
        return out
    longest = (n - 1).bit_length()
    short = (1 << longest) - n
    for i, s in enumerate(used):
        out[s] = longest - (i < short)
    return out


def _codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (its code's bits as they are written, how many); none for a lone symbol."""
    out, code, last = {}, 0, 0
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    for n, s in used:
        code <<= n - last
        last = n
        out[s] = int(f"{code:0{n}b}"[::-1], 2), n
        code += 1
    return out


def _runs(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra bits, how many): runs of zeros and repeats are shortened."""
    out, at, before = [], 0, 8
    while at < len(lengths):
        v, n = lengths[at], 1
        while at + n < len(lengths) and lengths[at + n] == v:
            n += 1
        if v == 0 and n >= 11:
            n = min(n, 138)
            out.append((18, n - 11, 7))
        elif v == 0 and n >= 3:
            n = min(n, 10)
            out.append((17, n - 3, 3))
        elif v and v == before and n >= 3:
            n = min(n, 6)
            out.append((16, n - 3, 2))
        else:
            n = 1
            out.append((v, 0, 0))
            before = v or before
        at += n
    return out


def put_code(out: BitWriter, used: set[int], alphabet: int) -> dict[int, tuple[int, int]]:
    """Writes a prefix code for the used symbols: a simple one for one or two small symbols, else a normal one."""
    symbols = sorted(used) or [0]
    lengths = even_lengths(symbols, alphabet)
    if len(symbols) <= 2 and symbols[-1] < 256:
        out.put(1, 1).put(len(symbols) - 1, 1)
        out.put(1, 1).put(symbols[0], 8) if symbols[0] > 1 else out.put(0, 1).put(symbols[0], 1)
        if len(symbols) == 2:
            out.put(symbols[1], 8)
        return _codes(lengths)
    # what follows the last used symbol is left out by a count, where there is something to leave out
    runs = _runs(lengths[: symbols[-1] + 1])
    few = symbols[-1] + 1 < alphabet and len(runs) >= 2
    runs = runs if few else _runs(lengths)
    own = {r[0] for r in runs}
    own |= {0, 1} if len(own) == 1 else set()
    kinds = even_lengths(sorted(own), 19)
    stored = max(4, 1 + max(LENGTH_ORDER.index(s) for s in own))
    out.put(0, 1).put(stored - 4, 4)
    for s in LENGTH_ORDER[:stored]:
        out.put(kinds[s], 3)
    out.put(int(few), 1)
    if few:
        n = (len(runs) - 2).bit_length()
        bits = max(2, n + n % 2)
        out.put((bits - 2) // 2, 3).put(len(runs) - 2, bits)
    codes = _codes(kinds)
    for s, extra, n in runs:
        out.put(*codes[s]).put(extra, n)
    return _codes(lengths)


def put_pixels(out: BitWriter, pixels: list[int], width: int, main: bool, cache_bits: int = 0, group_bits: int = 0, copies: bool = True) -> None:
    """An entropy-coded image: runs and rows that repeat are copied, recent colours come from the cache."""
    height = len(pixels) // width
    near, cache = _near_codes(width), {}
    tokens: list[tuple] = []  # (place, green symbol, what follows it)
    at = 0
    while at < len(pixels):
        best = (0, 0)
        for d in (1, width, width + 1, 2 * width + 3) if copies else ():
            n = 0
            while d <= at and at + n < len(pixels) and n < 4096 and pixels[at + n] == pixels[at + n - d]:
                n += 1
            best = max(best, (n, -d))
        v = pixels[at]
        slot = (CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if best[0] >= 3:
            n, d = best[0], -best[1]
            tokens.append((at, 256 + prefixed(n)[0], prefixed(n), prefixed(near.get(d, d + len(NEAR)))))
        elif cache_bits and cache.get(slot) == v:
            n = 1
            tokens.append((at, 280 + slot))
        else:
            n = 1
            tokens.append((at, v >> 8 & 255, v))
        if cache_bits:
            for w in pixels[at : at + n]:
                cache[(CACHE_FACTOR * w & 0xFFFFFFFF) >> (32 - cache_bits)] = w
        at += n
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    group_of = [0]
    bw = (width + (1 << group_bits) - 1) >> group_bits
    if main:
        out.put(int(group_bits > 0), 1)
        if group_bits:
            bh = (height + (1 << group_bits) - 1) >> group_bits
            group_of = [(x + y) % 3 for y in range(bh) for x in range(bw)]
            out.put(group_bits - 2, 3)
            put_pixels(out, [g << 8 for g in group_of], bw, False)
    mine = lambda t: group_of[(t[0] // width >> group_bits) * bw + (t[0] % width >> group_bits)] if group_bits else 0
    used = [[set() for _ in range(5)] for _ in range(max(group_of) + 1)]
    for t in tokens:
        u = used[mine(t)]
        u[0].add(t[1])
        if t[1] < 256:
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                u[k].add(t[2] >> shift & 255)
        elif t[1] < 280:
            u[4].add(t[3][0])
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[put_code(out, s, n) for s, n in zip(u, sizes, strict=True)] for u in used]
    for t in tokens:
        c = codes[mine(t)]
        out.put(*c[0][t[1]])
        if t[1] < 256:
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                out.put(*c[k][t[2] >> shift & 255])
        elif t[1] < 280:
            out.put(*t[2][1:]).put(*c[4][t[3][0]]).put(*t[3][1:])


def _predicted(img: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """The predictor's guesses from a finished image, channel by channel on whole arrays."""
    h, w = img.shape
    p = planes(img)
    left, top = np.roll(p, 1, axis=1), np.roll(p, 1, axis=0)
    corner, right = np.roll(top, 1, axis=1), np.roll(top, -1, axis=1)
    right[:, -1] = p[:, 0]
    mean = lambda a, b: (a + b) // 2
    m = mean(left, top)
    spread = lambda a: np.abs(a - corner).sum(axis=-1, keepdims=True)
    black = np.broadcast_to(np.array([255, 0, 0, 0]), p.shape)
    every = [black, left, top, right, corner, mean(mean(left, right), top), mean(left, corner), m, mean(corner, top), mean(top, right), mean(mean(left, corner), mean(top, right)),
             np.where(spread(top) < spread(left), left, top), np.clip(left + top - corner, 0, 255), np.clip(m + np.trunc((m - corner) / 2).astype(np.int64), 0, 255)]
    mode = modes[np.arange(h)[:, None] >> bits, np.arange(w)[None] >> bits]
    out = np.choose(mode[..., None], every)
    out[0], out[:, 0], out[0, 0] = left[0], top[:, 0], black[0, 0]
    return out


def write_stream(img: np.ndarray, transforms: tuple[str, ...] = (), cache_bits: int = 0, group_bits: int = 0, block_bits: int = 2, copies: bool = True, header: bool = True, alpha: bool = True, seed: int = 1) -> bytes:
    """A stream with the given transforms, in order, of palette, predictor, color and green; side values by rule from `seed`."""
    img = np.asarray(img, np.int64)
    h, w = img.shape
    out = BitWriter()
    if header:
        out.put(0x2F, 8).put(w - 1, 14).put(h - 1, 14).put(int(alpha), 1).put(0, 3)
    for name in transforms:
        width = img.shape[1]
        bw, bh = (width + (1 << block_bits) - 1) >> block_bits, (h + (1 << block_bits) - 1) >> block_bits
        side = np.arange(bw * bh, dtype=np.int64).reshape(bh, bw) * 5 + seed
        p = planes(img)
        if name == "palette":
            colors, index = np.unique(img, return_inverse=True)
            need(len(colors) <= 256, "InvalidVP8LTransform")
            deltas = planes(colors)
            deltas[1:] -= planes(colors)[:-1]
            out.put(1, 1).put(PALETTE, 2).put(len(colors) - 1, 8)
            put_pixels(out, join(deltas).tolist(), len(colors), False, copies=copies)
            n = len(colors)
            wb = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            padded = np.zeros((h, -(-width >> wb) << wb), np.int64)
            padded[:, :width] = index.reshape(h, width)
            parts = padded.reshape(h, -1, 1 << wb)
            img = (parts << (np.arange(1 << wb) * (8 >> wb))).sum(axis=2) << 8
        elif name == "predictor":
            modes = side % 14
            out.put(1, 1).put(PREDICTOR, 2).put(block_bits - 2, 3)
            put_pixels(out, (modes << 8).ravel().tolist(), bw, False, copies=copies)
            img = join(p - _predicted(img, modes, block_bits))
        elif name == "color":
            element = (side * FACTOR_OF_SIDES) & 0xFFFFFF
            out.put(1, 1).put(COLOR, 2).put(block_bits - 2, 3)
            put_pixels(out, element.ravel().tolist(), bw, False, copies=copies)
            e = planes(element[np.arange(h)[:, None] >> block_bits, np.arange(width)[None] >> block_bits])
            s8 = lambda v: ((v & 255) ^ 128) - 128
            p[..., 3] -= (s8(e[..., 2]) * s8(p[..., 2]) >> 5) + (s8(e[..., 1]) * s8(p[..., 1]) >> 5)
            p[..., 1] -= s8(e[..., 3]) * s8(p[..., 2]) >> 5
            img = join(p)
        else:
            out.put(1, 1).put(SUBTRACT_GREEN, 2)
            p[..., 1], p[..., 3] = p[..., 1] - p[..., 2], p[..., 3] - p[..., 2]
            img = join(p)
    out.put(0, 1)
    put_pixels(out, img.ravel().tolist(), img.shape[1], True, cache_bits, group_bits, copies)
    return out.done()


FACTOR_OF_SIDES = 2654435761
BATCH_BYTES = 1 << 24
DECODED = "error string, width bigint, height bigint, rgba_sha256 string, pixels binary, literals bigint, copies bigint, cache_hits bigint"


def decode_static(data: bytes, limits: Limits = Limits()) -> dict:
    try:
        f = parse(data, limits)
        need(not f.flag(2), "UnsupportedAnimationDecode")
        need("image" in f.first, "MissingImageData")
        need(f.format == "lossless", "UnsupportedImageFormat")
        c, counts, budget = f.first["image"], {}, Budget(limits.allocation)
        n = f.canvas[0] * f.canvas[1]
        budget.take(4 * n + 4 * (n + SIDE_PIXELS) + 4 * n + 4 * n)
        img = decode(data[c.start : c.start + c.size], counts=counts, budget=budget)
        rgba = swizzle(img, "rgba")
        counts.pop("pixels")
        return {"width": img.shape[1], "height": img.shape[0], "rgba_sha256": hashlib.sha256(rgba).hexdigest(), "pixels": rgba, **counts}
    except ImageError as e:
        return {"error": e.name}


def decode_files(files: DataFrame, key: str, content: str = "content", limits: Limits = Limits()) -> DataFrame:
    """RGBA pixels of each still lossless file, or its error. Images are independent; a batch holds BATCH_BYTES of pixels or one image."""
    from .demux import arrow_type

    schema = f"{key} {dict(files.dtypes)[key]}, {DECODED}"
    arrow = arrow_type(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n in arrow.names if n != key]

        def made(keys: list, rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, arrow.field(key).type), *(pa.array([r.get(n) for r in rows], arrow.field(n).type) for n in names)], schema=arrow)

        for batch in batches:
            keys, rows, held = [], [], 0
            for k, d in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(k.as_py())
                rows.append(decode_static(d.as_py() or b"", limits))
                held += len(rows[-1].get("pixels", b"")) + 100
                if held >= BATCH_BYTES:
                    yield made(keys, rows)
                    keys, rows, held = [], [], 0
            if keys:
                yield made(keys, rows)

    return files.select(key, content).mapInArrow(run, schema).withColumn("category", category(F.col("error")))


def scan_streams(rows: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, error, pixels, literals, copies, cache_hits) of each stream, without keeping its pixels."""
    names = ("pixels", "literals", "copies", "cache_hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [summary(d or b"") for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.get("error") for r in out], pa.string()), *(pa.array([r.get(n) for r in out], pa.int64()) for n in names)], names=[key, "error", *names])

    return rows.select(F.col(key).cast("long").alias(key), payload).mapInArrow(run, f"{key} long, error string, " + ", ".join(f"{n} long" for n in names))
