"""The lossy frame header, by the arithmetic decoder: up to the probabilities for queries, whole for decoding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .demux import need, u
from .errors import ImageError, category
from .vp8 import BoolReader, BoolWriter
from .vp8_tables import Tables

COLUMNS = "error string, width bigint, height bigint, version bigint, color_space bigint, clamping bigint, segmented boolean, absolute boolean, quant array<bigint>, strength array<bigint>, map_probs array<bigint>, simple_filter boolean, level bigint, sharpness bigint, deltas array<bigint>, partitions bigint, base_q bigint, q_deltas array<bigint>"
DELTAS = 5


def read_header(payload: bytes) -> dict:
    return start_header(payload)[0]


def start_header(payload: bytes) -> tuple[dict, BoolReader]:
    """The fields up to the quantiser, and the reader behind them."""
    need(len(payload) >= 10, "InvalidVP8Header")
    tag = u(payload, 0, 3)
    first = tag >> 5
    need(not tag & 1 and (tag >> 1) & 7 <= 3 and (tag >> 4) & 1 == 1 and payload[3:6] == b"\x9d\x01\x2a" and first <= len(payload) - 10, "InvalidVP8Header")
    w, h = u(payload, 6, 2), u(payload, 8, 2)
    out = {"width": w & 0x3FFF, "height": h & 0x3FFF, "version": (tag >> 1) & 7}
    r = BoolReader(payload[10 : 10 + first])
    optional = lambda read, none: [read() if r.get() else none for _ in range(4)]
    out |= {"color_space": r.get(), "clamping": r.get(), "segmented": bool(r.get()), "new_map": False, "absolute": False, "quant": [0] * 4, "strength": [0] * 4, "map_probs": [255] * 3}
    if out["segmented"]:
        new_map, new_data = r.get(), r.get()
        out["new_map"] = bool(new_map)
        if new_data:
            out["absolute"] = bool(r.get())
            out["quant"] = optional(lambda: r.signed(7), 0)
            out["strength"] = optional(lambda: r.signed(6), 0)
        if new_map:
            out["map_probs"] = [r.literal(8) if r.get() else 255 for _ in range(3)]
    out |= {"simple_filter": bool(r.get()), "level": r.literal(6), "sharpness": r.literal(3), "deltas": [0] * 8}
    if r.get() and r.get():
        out["deltas"] = optional(lambda: r.signed(6), 0) + optional(lambda: r.signed(6), 0)
    out["partitions"] = 1 << r.literal(2)
    out["base_q"] = r.literal(7)
    out["q_deltas"] = [r.signed(4) if r.get() else 0 for _ in range(DELTAS)]
    return out, r


def whole_header(payload: bytes, tables: Tables) -> tuple[dict, BoolReader]:
    """All fields, with the frame's coefficient probabilities; the reader stands before the macroblock records."""
    out, r = start_header(payload)
    need(out["width"] > 0 and out["height"] > 0, "InvalidCanvasSize")
    out["refresh"] = bool(r.get())
    probabilities = [r.literal(8) if r.get(u) else p for u, p in zip(tables.updates, tables.coefficients, strict=True)]
    out["probabilities"] = Tables.planes(probabilities)
    out["skip_probability"] = r.literal(8) if r.get() else None
    return out, r


def token_partitions(payload: bytes, first: int, count: int) -> list[bytes]:
    """The coefficient partitions: all but the last say their size; the last has the rest and isn't empty."""
    at = 10 + first
    sizes = at + 3 * (count - 1)
    need(sizes <= len(payload), "TruncatedBitstream")
    out, start = [], sizes
    for k in range(count - 1):
        n = u(payload, at + 3 * k, 3)
        need(start + n <= len(payload), "TruncatedBitstream")
        out.append(payload[start : start + n])
        start += n
    need(start < len(payload), "TruncatedBitstream")
    return [*out, payload[start:]]


def put_header(b: BoolWriter, segments: list[int] | None, level: int, sharpness: int, log2_parts: int, base_q: int, q_deltas: list[int], absolute: bool = True, strengths: list[int] | None = None, map_probs: list[int] | None = None, deltas: list[int] | None = None) -> None:
    """The fields up to the quantiser. segments: a quantiser index (or its difference) each; map_probs: 255 is none."""
    b.put(0).put(1).put(int(segments is not None))
    if segments is not None:
        b.put(int(map_probs is not None)).put(1).put(int(absolute))
        for v in segments:
            b.put(1).signed(v, 7)
        for v in strengths or [0] * 4:
            b.flagged(v, 6)
        for v in map_probs or []:
            b.put(int(v != 255))
            if v != 255:
                b.literal(v, 8)
    b.put(0).literal(level, 6).literal(sharpness, 3).put(int(deltas is not None))
    if deltas is not None:
        b.put(1)
        for v in deltas:
            b.flagged(v, 6)
    b.literal(log2_parts, 2).literal(base_q, 7)
    for v in q_deltas:
        b.flagged(v, 4)


def framed(w: int, h: int, body: bytes) -> bytes:
    """The uncompressed head before the first partition."""
    return (len(body) << 5 | 1 << 4).to_bytes(3, "little") + b"\x9d\x01\x2a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + body


def write_header(w: int, h: int, segments: list[int] | None, level: int, sharpness: int, log2_parts: int, base_q: int, q_deltas: list[int], **more) -> bytes:
    """A frame header up to the quantiser whose fields are as given."""
    b = BoolWriter()
    put_header(b, segments, level, sharpness, log2_parts, base_q, q_deltas, **more)
    return framed(w, h, b.done())


def read_headers(rows: DataFrame, key: str) -> DataFrame:
    """(key, payload) -> the header's fields, or the error."""
    from .demux import arrow_type

    schema = f"{key} long, {COLUMNS}"
    arrow = arrow_type(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out.append({key: k} | read_header(payload))
                except ImageError as e:
                    out.append({key: k, "error": e.name})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.select(F.col(key).cast("long").alias(key), "payload").mapInArrow(run, schema).withColumn("category", category(F.col("error")))


def split_partitions(rows: DataFrame, key: str) -> DataFrame:
    """(key, payload) -> the coefficient partitions as bytes, or the error; a header that can't be read gives its own."""
    from .demux import arrow_type

    schema = f"{key} long, error string, partitions array<binary>"
    arrow = arrow_type(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    count = read_header(payload)["partitions"]
                    out.append({key: k, "partitions": token_partitions(payload, u(payload, 0, 3) >> 5, count)})
                except ImageError as e:
                    out.append({key: k, "error": e.name})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.select(F.col(key).cast("long").alias(key), "payload").mapInArrow(run, schema)


def partition_of(row: Column, count: Column) -> Column:
    """The partition that holds a row of macroblocks."""
    return F.pmod(row, count)
