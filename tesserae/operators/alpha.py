"""The alpha plane: header, filters and decoding of a whole chunk payload. One kernel call a plane."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .demux import need
from .errors import ImageError, category
from .vp8l import decode

FILTERS = ("none", "horizontal", "vertical", "gradient")


def header(byte: int) -> tuple[int, int, int]:
    """(compression, filter, preprocessing); reserved bits must be clear here."""
    need(byte >> 6 == 0 and byte & 3 <= 1 and (byte >> 4) & 3 <= 1, "InvalidAlphaChunk")
    return byte & 3, (byte >> 2) & 3, (byte >> 4) & 3


def unfilter(plane: np.ndarray, kind: int) -> np.ndarray:
    d = plane.astype(np.int64)
    if kind == 0:
        return plane
    if kind == 1:
        d[1:, 0] += np.cumsum(d[:, 0])[:-1]
        return np.cumsum(d, axis=1).astype(np.uint8)
    if kind == 2:
        d[0] = np.cumsum(d[0])
        return np.cumsum(d, axis=0).astype(np.uint8)
    above = (np.cumsum(d[0]) & 255).tolist()
    rows = [above]
    for residual in d[1:].tolist():
        left = (residual[0] + above[0]) & 255
        row = [left]
        for k in range(1, len(residual)):
            guess = left + above[k] - above[k - 1]
            left = (residual[k] + (0 if guess < 0 else 255 if guess > 255 else guess)) & 255
            row.append(left)
        rows.append(row)
        above = row
    return np.array(rows, np.uint8)


def filtered(plane: np.ndarray, kind: int) -> np.ndarray:
    """What unfilter undoes."""
    p = plane.astype(np.int64)
    guess = np.zeros_like(p)
    if kind:
        guess[0, 1:], guess[1:, 0] = p[0, :-1], p[:-1, 0]
        left, top, corner = p[1:, :-1], p[:-1, 1:], p[:-1, :-1]
        guess[1:, 1:] = (left, top, np.clip(left + top - corner, 0, 255))[kind - 1]
    return ((p - guess) & 255).astype(np.uint8)


def decode_plane(payload: bytes, w: int, h: int) -> np.ndarray:
    need(len(payload) >= 1, "InvalidAlphaChunk")
    compression, kind, _ = header(payload[0])
    if compression:
        plane = (decode(payload[1:], headerless=(w, h)) >> 8 & 255).astype(np.uint8)
    else:
        need(len(payload) - 1 >= w * h, "InvalidAlphaChunk")  # what follows the plane is ignored
        plane = np.frombuffer(payload, np.uint8, w * h, 1).reshape(h, w)
    return unfilter(plane, kind)


def unfilter_ragged(data: bytes, width: int, kind: int) -> np.ndarray:
    """A plane whose last row may be short: what isn't there changes nothing before it."""
    padded = np.zeros(-(-len(data) // width) * width, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return unfilter(padded.reshape(-1, width), kind).ravel()[: len(data)] if len(data) else padded


def decode_planes(rows: DataFrame, key: str) -> DataFrame:
    """(key, payload, width, height) -> (key, error, category, bytes, plane_sha256, plane); the plane is there to be sunk."""
    schema = f"{key} long, error string, bytes long, plane_sha256 string, plane binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, payload, w, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    plane = decode_plane(payload, w, h).tobytes()
                    out.append((k, None, len(plane), hashlib.sha256(plane).hexdigest(), plane))
                except ImageError as e:
                    out.append((k, e.name, None, None, None))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=[key, "error", "bytes", "plane_sha256", "plane"])

    return rows.select(F.col(key).cast("long").alias(key), "payload", "width", "height").mapInArrow(run, schema).withColumn("category", category(F.col("error")))
