"""Lossy key frames: macroblock records, coefficient tokens and unfiltered reconstruction, one kernel call a frame.

The frame is one bordered canvas a plane: 127 above it, 129 to its left. A macroblock's samples are predicted from the
canvas and written into it; its residuals are transformed together, as numpy arrays over blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .demux import need, u
from .errors import ImageError, category
from .vp8 import FULL_MODES, NUMBERS, SUBBLOCK_MODES, BoolReader, BoolWriter, factor_values, full_block, inverse_dct, inverse_wht, subblock
from .vp8_header import framed, put_header, token_partitions, whole_header
from .vp8_tables import Tables

# Fixed values. Trees: (number of the probability, branch of 0, branch of 1).
SEGMENT = (0, (1, 0, 1), (2, 2, 3))
LUMA = (0, "subblocks", (1, (2, "dc", "vertical"), (3, "horizontal", "true_motion")))
CHROMA = (0, "dc", (1, "vertical", (2, "horizontal", "true_motion")))
SUBBLOCK = (0, "dc", (1, "true_motion", (2, "vertical", (3, (4, "horizontal", (5, "right_down", "vertical_right")), (6, "left_down", (7, "vertical_left", (8, "horizontal_down", "horizontal_up")))))))
VALUE = (2, 1, (3, (4, 2, (5, 3, 4)), (6, (7, "c1", "c2"), (8, (9, "c3", "c4"), (10, "c5", "c6")))))
LUMA_PROBABILITIES, CHROMA_PROBABILITIES = (145, 156, 163, 128), (142, 114, 183)
# Fixed values. Ranges of large values: the least one, and the probabilities of the bits above it.
RANGES = {
    "c1": (5, (159,)), "c2": (7, (165, 145)), "c3": (11, (173, 148, 140)), "c4": (19, (176, 155, 140, 135)),
    "c5": (35, (180, 157, 141, 134, 130)), "c6": (67, (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129)),
}
# A coefficient's band by its place in the stream, and its place in the block.
BAND = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7, 0)
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
#: Planes of the coefficient table: luma without its DC, the second-order block, chroma, luma with its DC.
AFTER_Y2, Y2, UV, WITH_DC = range(4)


def read_tree(r: BoolReader, tree, probabilities):
    while isinstance(tree, tuple):
        tree = tree[1 + r.get(probabilities[tree[0]])]
    return tree


def put_tree(b: BoolWriter, tree, probabilities, leaf) -> None:
    def path(node):
        if not isinstance(node, tuple):
            return [] if node == leaf and type(node) is type(leaf) else None
        for bit in (0, 1):
            if (rest := path(node[1 + bit])) is not None:
                return [(bit, node[0]), *rest]
        return None

    for bit, k in path(tree):
        b.put(bit, probabilities[k])


@dataclass
class Macroblock:
    """coefficients: 25 blocks in the stream's order (second-order block, 16 luma, 4 U, 4 V), values as coded, by place in the stream."""

    luma: str = "dc"
    chroma: str = "dc"
    subblocks: tuple[str, ...] = ()
    segment: int = 0
    skip: bool = False
    coefficients: dict[int, list[int]] = field(default_factory=dict)

    @property
    def modes(self) -> tuple[str, ...]:
        """The mode of each luma subblock: its own, or the one its macroblock's mode stands for."""
        return self.subblocks if self.luma == "subblocks" else (self.luma,) * 16


def _contexts(modes: tuple[str, ...], k: int, above: list[str], left: list[str]) -> tuple[int, int]:
    up = modes[k - 4] if k >= 4 else above[k]
    before = modes[k - 1] if k % 4 else left[k // 4]
    return SUBBLOCK_MODES.index(up), SUBBLOCK_MODES.index(before)


def read_records(r: BoolReader, head: dict, columns: int, rows: int, tables: Tables) -> list[Macroblock]:
    """The prediction records of all macroblocks, row by row. What lies outside of the frame counts as flat."""
    out: list[Macroblock] = []
    above = [["dc"] * 4 for _ in range(columns)]
    for _ in range(rows):
        left = ["dc"] * 4
        for x in range(columns):
            m = Macroblock()
            m.segment = read_tree(r, SEGMENT, head["map_probs"]) if head["new_map"] else 0
            m.skip = bool(r.get(head["skip_probability"])) if head["skip_probability"] is not None else False
            m.luma = read_tree(r, LUMA, LUMA_PROBABILITIES)
            if m.luma == "subblocks":
                modes: list[str] = []
                for k in range(16):
                    modes.append(read_tree(r, SUBBLOCK, tables.subblock(*_contexts(modes, k, above[x], left))))
                m.subblocks = tuple(modes)
            m.chroma = read_tree(r, CHROMA, CHROMA_PROBABILITIES)
            above[x], left = list(m.modes[12:]), list(m.modes[3::4])
            out.append(m)
    return out


def read_block(r: BoolReader, plane: list, context: int, first: int) -> tuple[int, list[int]]:
    """(where it ended, values by place in the stream). After a zero there is no end."""
    values, at = [0] * 16, first
    p = plane[BAND[at]][context]
    while at < 16 and r.get(p[0]):
        while not r.get(p[1]):
            at += 1
            if at == 16:
                return 16, values
            p = plane[BAND[at]][0]
        v = read_tree(r, VALUE, p)
        if isinstance(v, str):
            v, bits = RANGES[v]
            extra = 0
            for q in bits:
                extra = 2 * extra + r.get(q)
            v += extra
        values[at] = -v if r.get() else v
        at += 1
        p = plane[BAND[at]][min(v, 2)]
    return at, values


def put_block(b: BoolWriter, plane: list, context: int, first: int, values: list[int]) -> int:
    """What read_block reads; gives where it ended."""
    end = max((k + 1 for k in range(first, 16) if values[k]), default=first)
    p, ended = plane[BAND[first]][context], True
    for k in range(first, end):
        if ended:
            b.put(1, p[0])
        v = abs(values[k])
        b.put(int(v > 0), p[1])
        ended = v > 0
        if v:
            leaf = v if v <= 4 else next(c for c in reversed(RANGES) if v >= RANGES[c][0])
            put_tree(b, VALUE, p, leaf)
            if v > 4:
                least, bits = RANGES[leaf]
                for i, q in enumerate(bits):
                    b.put((v - least) >> (len(bits) - 1 - i) & 1, q)
            b.put(int(values[k] < 0))
        p = plane[BAND[k + 1]][min(v, 2)]
    if end < 16:
        b.put(0, p[0])
    return end


class Edges:
    """Which neighbouring blocks had values: 4 luma, 2 U, 2 V and the second-order block, above each column and to the left."""

    def __init__(self, columns: int):
        self.above, self.left = [[0] * 9 for _ in range(columns)], [0] * 9

    def new_row(self) -> None:
        self.left = [0] * 9

    def skipped(self, x: int, has_y2: bool) -> None:
        # the second-order flags outlast macroblocks that have no such block
        for side in (self.above[x], self.left):
            side[: 9 if has_y2 else 8] = [0] * (9 if has_y2 else 8)

    def each(self, x: int, has_y2: bool, step) -> None:
        """Calls step(block, plane, context, first), which gives where the block ended, in the stream's order."""
        blocks = [(0, Y2, 8, 8, 0)] if has_y2 else []
        blocks += [(1 + k, AFTER_Y2 if has_y2 else WITH_DC, k % 4, k // 4, int(has_y2)) for k in range(16)]
        blocks += [(17 + k, UV, 4 + k // 4 * 2 + k % 2, 4 + k // 4 * 2 + k % 4 // 2, 0) for k in range(8)]
        for block, plane, up, side, first in blocks:
            end = step(block, plane, self.above[x][up] + self.left[side], first)
            self.above[x][up] = self.left[side] = int(end > first)


def read_coefficients(r: BoolReader, m: Macroblock, probabilities: list, edges: Edges, x: int) -> None:
    has_y2 = m.luma != "subblocks"
    if m.skip:
        edges.skipped(x, has_y2)
        return

    def step(block: int, plane: int, context: int, first: int) -> int:
        end, values = read_block(r, probabilities[plane], context, first)
        if any(values):
            m.coefficients[block] = values
        return end

    edges.each(x, has_y2, step)


def dequantised(m: Macroblock, factors: dict[str, int]) -> np.ndarray:
    """(25, 16) coefficients by place in the block, wrapped to 16 bits; second-order values are in the luma blocks."""
    out = np.zeros((25, 16), np.int64)
    for block, values in m.coefficients.items():
        kind = "y2" if block == 0 else "y1" if block < 17 else "uv"
        steps = [factors[kind + "_dc"]] + [factors[kind + "_ac"]] * 15
        for k, v in enumerate(values):
            if v:
                out[block, ZIGZAG[k]] = NUMBERS.wrap(v * steps[k])
    if m.luma != "subblocks":
        out[1:17, 0] = inverse_wht(out[0].tolist(), NUMBERS)
    return out


class Canvas:
    """The three bordered planes of a frame."""

    def __init__(self, columns: int, rows: int):
        self.columns = columns
        self.planes = []
        for n in (16, 8, 8):
            p = np.full((1 + n * rows, 1 + n * columns + 4), 127, np.int64)
            p[1:, 0] = 129
            self.planes.append(p)

    def add(self, m: Macroblock, x: int, y: int, coefficients: np.ndarray) -> None:
        """Predicts a macroblock and adds its residuals."""
        residual = np.array(inverse_dct(list(coefficients.T), NUMBERS)).T.reshape(25, 4, 4)
        self._luma(m, x, y, residual[1:17])
        for plane, first in ((1, 17), (2, 21)):
            rest = residual[first : first + 4].reshape(2, 2, 4, 4).swapaxes(1, 2).reshape(8, 8)
            self._full(plane, 8, m.chroma, x, y, rest)

    def _full(self, plane: int, n: int, mode: str, x: int, y: int, residual: np.ndarray) -> None:
        p, top, left = self.planes[plane], n * y, n * x
        block = full_block(mode, p[top, left + 1 : left + n + 1], p[top + 1 : top + n + 1, left], int(p[top, left]), y > 0, x > 0)
        p[top + 1 : top + n + 1, left + 1 : left + n + 1] = np.clip(block + residual, 0, 255)

    def _luma(self, m: Macroblock, x: int, y: int, residual: np.ndarray) -> None:
        if m.luma != "subblocks":
            self._full(0, 16, m.luma, x, y, residual.reshape(4, 4, 4, 4).swapaxes(1, 2).reshape(16, 16))
            return
        p, top, left = self.planes[0], 16 * y, 16 * x
        # what stands right above the macroblock serves all subblocks of its right edge; past the frame the last sample goes on
        beyond = p[top, left + 17 : left + 21].tolist() if y == 0 or x + 1 < self.columns else [int(p[top, left + 16])] * 4
        for k, mode in enumerate(m.subblocks):
            r, c = top + 4 * (k // 4), left + 4 * (k % 4)
            above = p[r, c + 1 : c + 5].tolist() + (beyond if k % 4 == 3 else p[r, c + 5 : c + 9].tolist())
            block = subblock(mode, int(p[r, c]), above, p[r + 1 : r + 5, c].tolist(), NUMBERS)
            p[r + 1 : r + 5, c + 1 : c + 5] = np.clip(np.array(block).reshape(4, 4) + residual[k], 0, 255)

    def samples(self) -> list[np.ndarray]:
        return [p[1:, 1:-4].astype(np.uint8) for p in self.planes]


@dataclass
class Frame:
    """Planes padded to whole macroblocks; a chroma sample covers two by two luma samples."""

    width: int
    height: int
    planes: list[np.ndarray]
    records: list[Macroblock]

    def cropped(self) -> list[np.ndarray]:
        w, h = self.width, self.height
        return [p[:b, :a] for p, a, b in zip(self.planes, (w, (w + 1) // 2, (w + 1) // 2), (h, (h + 1) // 2, (h + 1) // 2), strict=True)]

    def yuv(self) -> bytes:
        """Y, U and V of the picture, row by row, without padding."""
        return b"".join(np.ascontiguousarray(p).tobytes() for p in self.cropped())


def decode_frame(payload: bytes, tables: Tables) -> Frame:
    """A key frame's samples, before any loop filter."""
    head, r = whole_header(payload, tables)
    w, h = head["width"], head["height"]
    columns, rows = (w + 15) >> 4, (h + 15) >> 4
    parts = [BoolReader(p) for p in token_partitions(payload, u(payload, 0, 3) >> 5, head["partitions"])]
    records = read_records(r, head, columns, rows, tables)
    index = [head["base_q"] if not head["segmented"] else q if head["absolute"] else head["base_q"] + q for q in head["quant"]]
    factors = [factor_values(q, head["q_deltas"]) for q in index]
    canvas, edges = Canvas(columns, rows), Edges(columns)
    for y in range(rows):
        edges.new_row()
        for x in range(columns):
            m = records[y * columns + x]
            read_coefficients(parts[y % len(parts)], m, head["probabilities"], edges, x)
            canvas.add(m, x, y, dequantised(m, factors[m.segment]))
    return Frame(w, h, canvas.samples(), records)


def write_frame(w: int, h: int, records: list[Macroblock], tables: Tables, base_q: int = 20, q_deltas: tuple[int, ...] = (0,) * 5, segments: list[int] | None = None, absolute: bool = True, map_probs: list[int] | None = None, log2_parts: int = 0, skip_probability: int | None = 100, updates: dict[int, int] | None = None) -> bytes:
    """The key frame of the given records. updates: coefficient probabilities, by their number, that the frame changes."""
    b, columns = BoolWriter(), (w + 15) >> 4
    put_header(b, segments, 0, 0, log2_parts, base_q, list(q_deltas), absolute=absolute, map_probs=map_probs)
    b.put(1)
    flat = list(tables.coefficients)
    for k, at in enumerate(tables.updates):
        b.put(int(k in (updates or {})), at)
        if k in (updates or {}):
            flat[k] = updates[k]
            b.literal(flat[k], 8)
    b.put(int(skip_probability is not None))
    if skip_probability is not None:
        b.literal(skip_probability, 8)
    above, left = [["dc"] * 4 for _ in range(columns)], ["dc"] * 4
    for i, m in enumerate(records):
        x = i % columns
        left = left if x else ["dc"] * 4
        if segments is not None and map_probs is not None:
            put_tree(b, SEGMENT, map_probs, m.segment)
        if skip_probability is not None:
            b.put(int(m.skip), skip_probability)
        put_tree(b, LUMA, LUMA_PROBABILITIES, m.luma)
        for k, mode in enumerate(m.subblocks):
            put_tree(b, SUBBLOCK, tables.subblock(*_contexts(m.subblocks, k, above[x], left)), mode)
        put_tree(b, CHROMA, CHROMA_PROBABILITIES, m.chroma)
        above[x], left = list(m.modes[12:]), list(m.modes[3::4])
    parts, edges, probabilities = [BoolWriter() for _ in range(1 << log2_parts)], Edges(columns), Tables.planes(flat)
    for i, m in enumerate(records):
        x, y = i % columns, i // columns
        if x == 0:
            edges.new_row()
        has_y2, out = m.luma != "subblocks", parts[y % len(parts)]
        if m.skip and skip_probability is not None:
            edges.skipped(x, has_y2)
        else:
            edges.each(x, has_y2, lambda block, plane, context, first, m=m, out=out: put_block(out, probabilities[plane], context, first, m.coefficients.get(block, [0] * 16)))
    done = [p.done() for p in parts]
    return framed(w, h, b.done()) + b"".join(len(p).to_bytes(3, "little") for p in done[:-1]) + b"".join(done)


RECORD = "struct<segment:bigint,skip:boolean,luma:string,chroma:string,subblocks:array<string>,n_values:bigint,weighted:bigint>"
FRAME = f"error string, width bigint, height bigint, luma_stride bigint, chroma_stride bigint, y binary, u binary, v binary, yuv binary, yuv_sha256 string, records array<{RECORD}>"


def _record(m: Macroblock) -> dict:
    weighted = sum(v * (16 * block + k + 1) for block, values in m.coefficients.items() for k, v in enumerate(values))
    return {"segment": m.segment, "skip": m.skip, "luma": m.luma, "chroma": m.chroma, "subblocks": list(m.modes), "n_values": sum(v != 0 for x in m.coefficients.values() for v in x), "weighted": weighted}


def decode_frames(rows: DataFrame, key: str, tables: Tables, payload: str = "payload") -> DataFrame:
    """(key, FRAME columns, category) of each lossy bitstream: padded planes, the picture as raw YUV, macroblock records."""
    from .demux import arrow_type

    schema = f"{key} long, {FRAME}"
    arrow = arrow_type(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                out = {key: k.as_py()}
                try:
                    f = decode_frame(data.as_py() or b"", tables)
                    yuv = f.yuv()
                    y, cu, cv = f.planes
                    out |= {"width": f.width, "height": f.height, "luma_stride": y.shape[1], "chroma_stride": cu.shape[1], "y": y.tobytes(), "u": cu.tobytes(), "v": cv.tobytes(), "yuv": yuv, "yuv_sha256": hashlib.sha256(yuv).hexdigest(), "records": [_record(m) for m in f.records]}
                except ImageError as e:
                    out["error"] = e.name
                yield pa.RecordBatch.from_pylist([out], schema=arrow)  # a frame by itself: one may be large

    return rows.select(F.col(key).cast("long").alias(key), payload).mapInArrow(run, schema).withColumn("category", category(F.col("error")))


__all__ = ["FULL_MODES", "Frame", "Macroblock", "decode_frame", "decode_frames", "write_frame"]
