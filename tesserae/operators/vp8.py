"""Lossy arithmetic: quantiser factors, inverse transforms, prediction, the arithmetic coder.

Transforms and subblock prediction are written once over `Ops`: as column expressions, or on whole numbers and numpy
arrays within a frame's kernel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bits import clamp_byte, wrap_signed
from .errors import ImageError

# The DC and AC quantiser steps by index.
DC = (
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17, 18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 46, 47, 48, 49, 50,
    51, 52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89, 91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110,
    112, 114, 116, 118, 122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
)
AC = (
    4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 60,
    62, 64, 66, 68, 70, 72, 74, 76, 78, 80, 82, 84, 86, 88, 90, 92, 94, 96, 98, 100, 102, 104, 106, 108, 110, 112, 114, 116, 119, 122, 125, 128, 131, 134, 137, 140, 143, 146, 149, 152, 155, 158, 161, 164, 167, 170, 173, 177,
    181, 185, 189, 193, 197, 201, 205, 209, 213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
)


@dataclass(frozen=True)
class Ops:
    """Floor shift, clamp to a byte, wrap to 16 bits."""

    shift: Callable[[Any, int], Any]
    clamp: Callable[[Any], Any]
    wrap: Callable[[Any], Any]


COLUMNS = Ops(F.shiftright, clamp_byte, lambda v: wrap_signed(v, 16))
NUMBERS = Ops(lambda v, n: v >> n, lambda v: 0 if v < 0 else 255 if v > 255 else v, lambda v: ((v + 32768) & 65535) - 32768)


def segment_index(base: Column, delta: Column, enabled: Column, absolute: Column) -> Column:
    return F.when(~enabled, base).when(absolute, delta).otherwise(base + delta)


def factors(base: Column, deltas: dict[str, Column]) -> Column:
    """Six steps from a base index and the deltas y1_dc, y2_dc, y2_ac, uv_dc, uv_ac."""
    step = lambda values, q: F.element_at(F.array(*[F.lit(v) for v in values]), (F.greatest(F.lit(0), F.least(F.lit(127), q)) + 1).cast("int")).cast("long")
    return F.struct(
        step(DC, base + deltas["y1_dc"]).alias("y1_dc"),
        step(AC, base).alias("y1_ac"),
        (step(DC, base + deltas["y2_dc"]) * 2).alias("y2_dc"),
        F.greatest(F.lit(8).cast("long"), F.floor(step(AC, base + deltas["y2_ac"]) * 155 / 100)).alias("y2_ac"),
        F.least(F.lit(132).cast("long"), step(DC, base + deltas["uv_dc"])).alias("uv_dc"),
        step(AC, base + deltas["uv_ac"]).alias("uv_ac"),
    )


def factor_values(base: int, deltas: list[int]) -> dict[str, int]:
    """`factors` for one index, with the deltas in the order of the header."""
    step = lambda values, q: values[max(0, min(127, q))]
    y1_dc, y2_dc, y2_ac, uv_dc, uv_ac = deltas
    return {"y1_dc": step(DC, base + y1_dc), "y1_ac": step(AC, base), "y2_dc": 2 * step(DC, base + y2_dc), "y2_ac": max(8, step(AC, base + y2_ac) * 155 // 100), "uv_dc": min(132, step(DC, base + uv_dc)), "uv_ac": step(AC, base + uv_ac)}


def _dct(v: list, ops: Ops) -> list:
    cos = lambda a: ops.shift(a * 20091, 16) + a
    sin = lambda a: ops.shift(a * 35468, 16)
    even, odd = v[0] + v[2], v[0] - v[2]
    low, high = sin(v[1]) - cos(v[3]), cos(v[1]) + sin(v[3])
    return [even + high, odd + low, odd - low, even - high]


def inverse_dct(c: list, ops: Ops = COLUMNS) -> list:
    """16 residuals of 16 coefficients, row by row: columns first, then rows, rounded by 4 and shifted by 3."""
    down = [_dct([c[x + 4 * y] for y in range(4)], ops) for x in range(4)]
    out = []
    for y in range(4):
        row = [down[x][y] for x in range(4)]
        out += [ops.shift(v, 3) for v in _dct([row[0] + 4, *row[1:]], ops)]
    return out


def add_residual(predicted: list[Column], residual: list[Column]) -> list[Column]:
    """Samples with their residual, held within a byte."""
    return [clamp_byte(p + r) for p, r in zip(predicted, residual, strict=True)]


def inverse_wht(c: list, ops: Ops = COLUMNS) -> list:
    def pass_(v: list) -> list:
        a, b, d, e = v[0] + v[3], v[1] + v[2], v[1] - v[2], v[0] - v[3]
        return [a + b, e + d, a - b, e - d]

    down = [pass_([c[x + 4 * y] for y in range(4)]) for x in range(4)]
    out = []
    for y in range(4):
        row = [down[x][y] for x in range(4)]
        out += [ops.wrap(ops.shift(v, 3)) for v in pass_([row[0] + 3, *row[1:]])]
    return out


FULL_MODES = ("dc", "vertical", "horizontal", "true_motion")


def full_block(mode: str, above: np.ndarray, left: np.ndarray, corner: int, has_above: bool, has_left: bool) -> np.ndarray:
    """A square block from its edges; only the flat mode leaves edges outside of the frame out."""
    n = len(above)
    if mode == "vertical":
        return np.broadcast_to(above, (n, n))
    if mode == "horizontal":
        return np.broadcast_to(left[:, None], (n, n))
    if mode == "true_motion":
        return np.clip(left[:, None] + above[None] - corner, 0, 255)
    edges = np.concatenate([e for e, there in ((above, has_above), (left, has_left)) if there] or [np.full(n, 128)])
    return np.full((n, n), (int(edges.sum()) + len(edges) // 2) // len(edges))


def block_dc(above: Column, left: Column, n_log2: int, has_above: Column, has_left: Column) -> Column:
    """The flat value of a block from the sums of its edges."""
    n = 1 << n_log2
    one = lambda s: F.shiftright(s + (n >> 1), n_log2)
    return F.when(has_above & has_left, F.shiftright(above + left + n, n_log2 + 1)).when(has_above, one(above)).when(has_left, one(left)).otherwise(F.lit(128).cast("long"))


SUBBLOCK_MODES = ("dc", "true_motion", "vertical", "horizontal", "left_down", "right_down", "vertical_right", "vertical_left", "horizontal_down", "horizontal_up")


def subblock(mode: str, corner, above: list, left: list, ops: Ops = COLUMNS) -> list:
    """The 16 values of a 4x4 prediction, row by row; above has eight samples, left four from the top."""
    edge = {0: corner, **{k + 1: a for k, a in enumerate(above)}, **{-k - 1: v for k, v in enumerate(left)}}
    two = lambda a, b: ops.shift(a + b + 1, 1)
    three = lambda a, b, c: ops.shift(a + b * 2 + c + 2, 2)
    at = lambda k: three(edge[k - 1], edge[k], edge[k + 1])
    a, side = above, lambda k: left[min(k, 3)]

    def value(x: int, y: int):
        if mode == "dc":
            return ops.shift(sum(above[:4]) + sum(left) + 4, 3)
        if mode == "true_motion":
            return ops.clamp(left[y] + above[x] - corner)
        if mode == "vertical":
            return at(x + 1)
        if mode == "horizontal":
            return three(corner if y == 0 else left[y - 1], left[y], side(y + 1))
        if mode == "left_down":
            return three(a[x + y], a[min(x + y + 1, 7)], a[min(x + y + 2, 7)])
        if mode == "right_down":
            return at(x - y)
        if mode == "vertical_right":
            k = 2 * x - y
            return at(k + 1) if k < 0 else at((k + 1) // 2) if k % 2 else two(edge[k // 2], edge[k // 2 + 1])
        if mode == "vertical_left":
            i = x + y // 2
            if (x, y) in ((3, 2), (3, 3)):
                i = 4 + (y == 3)
                return three(a[i], a[i + 1], a[i + 2])
            return three(a[i], a[i + 1], a[i + 2]) if y % 2 else two(a[i], a[i + 1])
        if mode == "horizontal_down":
            k = 2 * y - x
            return at(-k - 1) if k < 0 else at(-(k + 1) // 2) if k % 2 else two(edge[-k // 2], edge[-k // 2 - 1])
        k = x + 2 * y
        i = k // 2
        return left[3] if k >= 6 else three(side(i), side(i + 1), side(i + 2)) if k % 2 else two(side(i), side(i + 1))

    return [value(x, y) for y in range(4) for x in range(4)]


def macroblocks(size: Column) -> Column:
    return F.shiftright(size.cast("long") + 15, 4)


def chroma(size: Column) -> Column:
    """Chroma samples along an edge: one for two, rounded up."""
    return F.shiftright(size.cast("long") + 1, 1)


class BoolWriter:
    """The arithmetic coder. The low end of its interval is a whole number of few bits; what can only change by a
    carry any more is in `out`."""

    def __init__(self):
        self.low, self.width, self.shift, self.out = 0, 255, 0, bytearray()

    def put(self, bit: int, probability: int = 128) -> BoolWriter:
        split = 1 + ((self.width - 1) * probability >> 8)
        if bit:
            self.low += split
            self.width -= split
        else:
            self.width = split
        if (k := 8 - self.width.bit_length()) > 0:
            self.low, self.width, self.shift = self.low << k, self.width << k, self.shift + k
            if self.shift >= 512:
                self._flush()
        return self

    def literal(self, value: int, n: int) -> BoolWriter:
        for k in range(n - 1, -1, -1):
            self.put(value >> k & 1)
        return self

    def signed(self, value: int, n: int) -> BoolWriter:
        return self.literal(abs(value), n).put(int(value < 0))

    def flagged(self, value: int, n: int) -> BoolWriter:
        """A flag, and the value if it isn't zero."""
        return self.put(1).signed(value, n) if value else self.put(0)

    def _flush(self) -> None:
        n = self.shift // 8
        left = self.shift + 8 - 8 * n
        top, self.low, self.shift = self.low >> left, self.low & ((1 << left) - 1), self.shift - 8 * n
        if top >> 8 * n:
            at = len(self.out) - 1
            while self.out[at] == 255:
                self.out[at] = 0
                at -= 1
            self.out[at] += 1
        self.out += (top & ((1 << 8 * n) - 1)).to_bytes(n, "big")

    def done(self) -> bytes:
        """The low end of the interval; its first byte stands for the first eight bits of range."""
        pad = -self.shift % 8 + 8
        self.low, self.shift = self.low << pad, self.shift + pad
        self._flush()
        return bytes(self.out) + bytes(4)


class BoolReader:
    """Reads what BoolWriter wrote; a byte past the end raises TruncatedBitstream."""

    def __init__(self, data: bytes):
        self.data, self.at, self.width, self.n = data, 2, 255, 0
        self.value = int.from_bytes((data[:2] + b"\0\0")[:2], "big")

    def get(self, probability: int = 128) -> int:
        split = 1 + ((self.width - 1) * probability >> 8)
        bit = self.value >= split << 8
        value, width, n, at = (self.value - (split << 8), self.width - split, self.n, self.at) if bit else (self.value, split, self.n, self.at)
        while width < 128:
            value, width, n = value << 1, width << 1, n + 1
            if n == 8:
                if at >= len(self.data):
                    raise ImageError("TruncatedBitstream")
                value, at, n = value | self.data[at], at + 1, 0
        self.value, self.width, self.n, self.at = value, width, n, at
        return int(bit)

    def literal(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.get()
        return out

    def signed(self, n: int) -> int:
        v = self.literal(n)
        return -v if self.get() else v
