"""Writing a still image's file from its parts, in canonical order, and rebuilding one from a parsed file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .container import KINDS, PAYLOAD_MAX
from .demux import ALPHA, EXIF, ICC, XMP, Chunk, Limits, bitstream, canvas_limit, need, parse
from .errors import ImageError, category

CANVAS_EDGE = 1 << 24


@dataclass
class Still:
    """A still image's parts. Metadata that is there but empty still makes a chunk."""

    width: int
    height: int
    lossless: bool
    bitstream: bytes
    alpha: bytes | None = None
    has_alpha: bool = False
    icc: bytes | None = None
    exif: bytes | None = None
    xmp: bytes | None = None
    unknown: list[tuple[bytes, bytes]] = field(default_factory=list)
    force_extended: bool = False

    @property
    def extended(self) -> bool:
        return self.force_extended or any(x is not None for x in (self.alpha, self.icc, self.exif, self.xmp)) or bool(self.unknown)

    def chunk_count(self) -> int:
        return 1 + self.extended + sum(x is not None for x in (self.alpha, self.icc, self.exif, self.xmp)) + len(self.unknown)


def chunk_bytes(tag: bytes, payload: bytes) -> bytes:
    need(len(payload) <= 0xFFFFFFFF, "ChunkTooLarge")
    return tag + len(payload).to_bytes(4, "little") + payload + bytes(len(payload) & 1)


def alpha_ok(payload: bytes, w: int, h: int) -> bool:
    """As the writer sees it: reserved bits must be clear."""
    return len(payload) >= 2 and payload[0] >> 6 == 0 and payload[0] & 3 <= 1 and (payload[0] >> 4) & 3 <= 1 and (payload[0] & 3 != 0 or len(payload) == w * h + 1)


def encode_static(s: Still, limits: Limits = Limits()) -> bytes:
    """The file, or the first fault of the parts."""
    need(s.width > 0 and s.height > 0, "InvalidCanvasSize")
    need(s.width * s.height <= 0xFFFFFFFF, "DimensionsOverflow")
    canvas_limit(s.width, s.height, limits)
    need(max(s.width, s.height) <= CANVAS_EDGE, "InvalidCanvasSize")
    need(s.chunk_count() <= limits.chunks, "TooManyChunks")
    need(all(tag.decode("latin-1") not in KINDS for tag, _ in s.unknown), "InvalidMuxChunk")
    kind = "lossless_bitstream" if s.lossless else "lossy_bitstream"
    _, w, h, hint = bitstream(s.bitstream, Chunk(b"", kind, -8, len(s.bitstream)))
    need((w, h) == (s.width, s.height), "InvalidMuxChunk")
    if s.alpha is not None:
        need(not s.lossless, "InvalidMuxChunk")
        need(alpha_ok(s.alpha, w, h), "InvalidAlphaChunk")
    need(not (s.lossless and s.has_alpha and not hint), "InvalidMuxChunk")
    has_alpha = hint if s.lossless else s.has_alpha or s.alpha is not None or hint
    need(s.lossless or not has_alpha or s.alpha is not None, "MissingRequiredChunk")
    flags = (has_alpha and ALPHA) | (s.icc is not None and ICC) | (s.exif is not None and EXIF) | (s.xmp is not None and XMP)
    head = [(b"VP8X", bytes([flags, 0, 0, 0]) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little"))] if s.extended else []
    parts = [*head, (b"ICCP", s.icc), (b"ALPH", s.alpha), (b"VP8L" if s.lossless else b"VP8 ", s.bitstream), (b"EXIF", s.exif), (b"XMP ", s.xmp), *s.unknown]
    payload = b"WEBP" + b"".join(chunk_bytes(tag, p) for tag, p in parts if p is not None)
    need(len(payload) <= PAYLOAD_MAX, "FileTooLarge")
    need(len(payload) + 8 <= limits.allocation, "AllocationLimitExceeded")
    return b"RIFF" + len(payload).to_bytes(4, "little") + payload


def remux(data: bytes, limits: Limits = Limits(), force_extended: bool = False) -> bytes:
    """The same still image, canonical: reserved alpha bits cleared, unknown chunks last, extended if it was or has to be."""
    f = parse(data, limits)
    need(not f.flag(2), "UnsupportedAnimationMux")
    body = lambda c: data[c.start : c.start + c.size]
    part = lambda kind: body(f.first[kind]) if kind in f.first else None
    alpha = part("alpha")
    alpha = alpha and bytes([alpha[0] & 0x3F]) + alpha[1:]
    unknown = [(c.tag, body(c)) for c in f.chunks if c.kind == "unknown"]
    return encode_static(Still(*f.canvas, f.format == "lossless", body(f.first["image"]), alpha, f.has_alpha, part("color_profile"), part("exif_metadata"), part("xmp_metadata"), unknown, force_extended or f.kind == "extended"), limits)


def _written(rows: DataFrame, key: str, columns: list[str], make) -> DataFrame:
    """(key, content, error, category): make(values) gives a file or raises its fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out.append((k, make(*values), None))
                except ImageError as e:
                    out.append((k, None, e.name))
            columns_ = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns_, (pa.int64(), pa.binary(), pa.string()), strict=True)], names=[key, "content", "error"])

    rows = rows.select(F.col(key).cast("long").alias(key), *columns)
    return rows.mapInArrow(run, f"{key} long, content binary, error string").withColumn("category", category(F.col("error")))


def remux_files(files: DataFrame, key: str, content: str = "content", force_extended: bool = False, limits: Limits = Limits()) -> DataFrame:
    return _written(files, key, [content], lambda data: remux(data or b"", limits, force_extended))


STILL = ("width", "height", "lossless", "bitstream", "alpha", "has_alpha", "icc", "exif", "xmp", "unknown", "force_extended")


def mux_stills(parts: DataFrame, key: str, limits: Limits = Limits()) -> DataFrame:
    """Files from rows of a Still's columns; unknown is an array of structs (tag string, payload binary) or null."""

    def make(*values) -> bytes:
        s = dict(zip(STILL, values, strict=True))
        s["unknown"] = [(c["tag"].encode("latin-1"), bytes(c["payload"])) for c in s["unknown"] or []]
        return encode_static(Still(**s), limits)

    return _written(parts, key, list(STILL), make)
