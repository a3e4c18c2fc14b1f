"""The strict container parser: one Arrow pass per file, faults as data.

A chunk walk is a chain of offsets, so it runs as a kernel over Arrow batches; what follows from the chunks is a
nested row per file that Catalyst can prune and explode. Only headers are read; payloads are referred to by offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .container import KINDS, PAYLOAD_MAX
from .errors import ImageError, category


@dataclass(frozen=True)
class Limits:
    """The default limits."""

    input_bytes: int = 0xFFFFFFFE
    pixels: int = 16_777_216
    animation_pixels: int = 16_777_216
    allocation: int = 256 * 1024 * 1024
    frames: int = 4096
    chunks: int = 65_536
    strict_padding: bool = True
    allow_trailing: bool = False


@dataclass
class Chunk:
    tag: bytes
    kind: str
    offset: int
    size: int

    @property
    def start(self) -> int:
        return self.offset + 8

    @property
    def end(self) -> int:
        return self.start + self.size + (self.size & 1)

    def row(self) -> dict:
        return {"tag": self.tag.decode("latin-1"), "kind": self.kind, "offset": self.offset, "payload_offset": self.start, "payload_size": self.size}


def u(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "little")


def need(ok: bool, error: str) -> None:
    if not ok:
        raise ImageError(error)


def envelope(data: bytes, limits: Limits) -> None:
    need(len(data) <= limits.input_bytes, "InputTooLarge")
    need(len(data) >= 12, "InputTooSmall")
    need(data[:4] == b"RIFF", "InvalidRiffSignature")
    need(data[8:12] == b"WEBP", "InvalidWebPSignature")
    size = u(data, 4, 4)
    need(size <= PAYLOAD_MAX, "FileTooLarge")
    need(size >= 4 and size % 2 == 0, "InvalidRiffSize")
    need(size + 8 <= len(data), "TruncatedChunkPayload")
    need(limits.allow_trailing or size + 8 == len(data), "TrailingData")


def walk(data: bytes, at: int, end: int, limits: Limits, budget: list[int]) -> Iterator[Chunk]:
    """The chunks from `at` to `end`; budget[0] counts them, those inside frames too."""
    while at < end:
        budget[0] += 1
        need(budget[0] <= limits.chunks, "TooManyChunks")
        need(at + 8 <= end, "TruncatedChunkHeader")
        tag = bytes(data[at : at + 4])
        c = Chunk(tag, KINDS.get(tag.decode("latin-1"), "unknown"), at, u(data, at + 4, 4))
        need(c.end <= end, "TruncatedChunkPayload")
        need(not (limits.strict_padding and c.size & 1 and data[c.end - 1]), "InvalidChunkPadding")
        yield c
        at = c.end


def dimensions(w: int, h: int) -> tuple[int, int]:
    need(w > 0 and h > 0, "InvalidCanvasSize")
    need(w * h <= 0xFFFFFFFF, "DimensionsOverflow")
    return w, h


def bitstream(data: bytes, c: Chunk) -> tuple[str, int, int, bool]:
    """(format, width, height, alpha hint) from the first bytes of a bitstream."""
    at, n = c.start, c.size
    if c.kind == "lossless_bitstream":
        need(n >= 5, "InvalidVP8LHeader")
        need(data[at] == 0x2F, "InvalidVP8LHeader")
        bits = u(data, at + 1, 4)
        need(bits >> 29 == 0, "InvalidVP8LHeader")
        return "lossless", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, bool(bits >> 28 & 1)
    need(n >= 10, "InvalidVP8Header")
    tag = u(data, at, 3)
    need(not tag & 1 and (tag >> 1) & 7 <= 3 and (tag >> 4) & 1 == 1 and tag >> 5 < n and data[at + 3 : at + 6] == b"\x9d\x01\x2a", "InvalidVP8Header")
    return ("lossy", *dimensions(u(data, at + 6, 2) & 0x3FFF, u(data, at + 8, 2) & 0x3FFF), False)


def alpha_chunk(data: bytes, c: Chunk, w: int, h: int) -> None:
    head = data[c.start] if c.size else 0
    need(c.size >= 2 and head & 3 <= 1 and (head >> 4) & 3 <= 1, "InvalidAlphaChunk")
    need(head & 3 != 0 or c.size == w * h + 1, "InvalidAlphaChunk")


def frame(data: bytes, c: Chunk, canvas: tuple[int, int], limits: Limits, budget: list[int]) -> dict:
    need(c.size >= 16, "InvalidFrameChunk")
    p = c.start
    x, y, w, h = 2 * u(data, p, 3), 2 * u(data, p + 3, 3), u(data, p + 6, 3) + 1, u(data, p + 9, 3) + 1
    need(x + w <= canvas[0] and y + h <= canvas[1], "InvalidFrameChunk")
    out = {"x": x, "y": y, "width": w, "height": h, "duration_ms": u(data, p + 12, 3), "blend": "overwrite" if data[p + 15] & 2 else "alpha", "dispose": "background" if data[p + 15] & 1 else "keep", "format": None, "has_alpha": False}
    seen: list[str] = []
    for inner in walk(data, p + 16, p + c.size, limits, budget):
        image = inner.kind in ("lossy_bitstream", "lossless_bitstream")
        need(image or inner.kind in ("alpha", "unknown"), "InvalidFrameChunk")
        # an alpha plane may only come first, an image once, anything unknown only after it
        need((not seen if inner.kind == "alpha" else seen in ([], ["alpha"])) if inner.kind != "unknown" else "image" in seen, "InvalidFrameChunk")
        if inner.kind == "alpha":
            alpha_chunk(data, inner, w, h)
            out["has_alpha"] = True
        elif image:
            need(not (seen and inner.kind == "lossless_bitstream"), "InvalidFrameChunk")
            fmt, bw, bh, hint = bitstream(data, inner)
            need((bw, bh) == (w, h), "InvalidFrameChunk")
            out |= {"format": fmt, "has_alpha": out["has_alpha"] or hint}
        seen.append("image" if image else inner.kind)
    need("image" in seen, "MissingImageData")
    return out


@dataclass
class File:
    """What a file turned out to be."""

    kind: str | None = None
    flags: int = 0
    canvas: tuple[int, int] | None = None
    format: str | None = None
    has_alpha: bool = False
    started: bool = False
    first: dict[str, Chunk] = field(default_factory=dict)
    chunks: list[Chunk] = field(default_factory=list)
    frames: list[dict] = field(default_factory=list)
    background: bytes | None = None
    loops: int | None = None

    def flag(self, mask: int) -> bool:
        return bool(self.flags & mask)


ICC, ALPHA, EXIF, XMP, ANIMATED = 0x20, 0x10, 0x08, 0x04, 0x02


def canvas_limit(w: int, h: int, limits: Limits, animated: bool = False) -> None:
    need(w * h <= (limits.animation_pixels if animated else limits.pixels), "CanvasTooLarge")


def take_image(f: File, data: bytes, c: Chunk, limits: Limits) -> None:
    need("image" not in f.first, "DuplicateImageData")
    fmt, w, h, hint = bitstream(data, c)
    if f.canvas is None:
        f.canvas = (w, h)
        canvas_limit(w, h, limits)
    need(f.canvas == (w, h), "InvalidFeatureFlags")
    f.format, f.has_alpha, f.first["image"] = fmt, f.has_alpha or hint, c


def take(f: File, data: bytes, c: Chunk, limits: Limits, budget: list[int]) -> None:
    kind, image = c.kind, c.kind in ("lossy_bitstream", "lossless_bitstream")
    if kind == "unknown":
        return
    if f.kind is None:
        if image:
            f.kind = "simple"
            take_image(f, data, c, limits)
        elif kind == "extended_header":
            f.kind, f.first[kind] = "extended", c
            need(c.size >= 10, "InvalidExtendedHeaderSize")
            f.flags = data[c.start]
            f.canvas = dimensions(u(data, c.start + 4, 3) + 1, u(data, c.start + 7, 3) + 1)
            canvas_limit(*f.canvas, limits, f.flag(ANIMATED))
        else:
            raise ImageError("MissingExtendedHeader")
        return
    need(f.kind == "extended", "InvalidSimpleChunk")
    animated = f.flag(ANIMATED)
    if kind in ("color_profile", "exif_metadata", "xmp_metadata"):
        need(kind not in f.first, "DuplicateMetadata")
        need(kind != "color_profile" or not f.started, "InvalidChunkOrder")
        f.first[kind] = c
    elif kind == "extended_header":
        raise ImageError("DuplicateChunk")
    elif kind == "alpha":
        need(not animated and "image" not in f.first, "InvalidChunkOrder")
        need(kind not in f.first, "DuplicateChunk")
        alpha_chunk(data, c, *f.canvas)
        f.first[kind], f.has_alpha, f.started = c, True, True
    elif image:
        need(not animated, "InvalidChunkOrder")
        take_image(f, data, c, limits)
        f.started = True
    elif kind == "animation" and animated:  # without the flag it is ignored
        need(kind not in f.first, "DuplicateChunk")
        need(not f.started, "InvalidChunkOrder")
        need(c.size == 6, "InvalidAnimationChunk")
        f.first[kind], f.started = c, True
        f.background, f.loops = bytes(data[c.start : c.start + 4]), u(data, c.start + 4, 2) or None
    elif kind == "animation_frame":
        need(animated, "InvalidChunkOrder")
        need("animation" in f.first, "MissingAnimationControl")
        need(len(f.frames) < limits.frames, "FrameCountTooLarge")
        f.frames.append(frame(data, c, f.canvas, limits, budget))
        f.first.setdefault(kind, c)
        f.started = True


def finish(f: File) -> None:
    need(f.kind is not None and f.canvas is not None, "MissingImageData")
    if f.kind == "simple":
        need("image" in f.first, "MissingImageData")
        return
    for mask, kind in ((ICC, "color_profile"), (EXIF, "exif_metadata"), (XMP, "xmp_metadata")):
        need(not f.flag(mask) or kind in f.first, "MissingRequiredChunk")
        need(f.flag(mask) or kind not in f.first, "InvalidFeatureFlags")
    alpha = any(x["has_alpha"] for x in f.frames) if f.flag(ANIMATED) else f.has_alpha
    if f.flag(ANIMATED):
        need("animation" in f.first, "MissingAnimationControl")
        need(bool(f.frames), "MissingImageData")
        f.has_alpha = alpha
    else:
        need("image" in f.first, "MissingImageData")
        need("alpha" not in f.first or f.format == "lossy", "InvalidChunkOrder")
    need(not alpha or f.flag(ALPHA), "InvalidFeatureFlags")
    need(alpha or not f.flag(ALPHA), "MissingRequiredChunk")


def parse(data: bytes, limits: Limits = Limits()) -> File:
    envelope(data, limits)
    f, budget = File(), [0]
    for c in walk(data, 12, u(data, 4, 4) + 8, limits, budget):
        f.chunks.append(c)
        take(f, data, c, limits, budget)
    finish(f)
    return f


CHUNK = "struct<tag:string,kind:string,offset:bigint,payload_offset:bigint,payload_size:bigint>"
WITH_PAYLOAD = CHUNK.replace(">", ",payload:binary>")
FRAME = "struct<x:bigint,y:bigint,width:bigint,height:bigint,duration_ms:bigint,blend:string,dispose:string,format:string,has_alpha:boolean>"
RESULT = f"error string, file_kind string, format string, width bigint, height bigint, has_alpha boolean, is_animation boolean, chunk_count bigint, file_size bigint, background binary, loop_count bigint, has_icc boolean, has_exif boolean, has_xmp boolean, chunks array<{CHUNK}>, frames array<{FRAME}>"


def describe(data: bytes | None, limits: Limits, payloads: bool = False) -> dict:
    """One nested row; a malformed file has an error and nulls. payloads: chunks come with their bytes."""
    if data is None:
        return {"error": "InputTooSmall"}
    try:
        f = parse(data, limits)
    except ImageError as e:
        return {"error": e.name, "file_size": len(data)}
    w, h = f.canvas
    return {"file_kind": f.kind, "format": f.format, "width": w, "height": h, "has_alpha": f.has_alpha, "is_animation": f.flag(ANIMATED), "chunk_count": len(f.chunks), "file_size": len(data), "background": f.background, "loop_count": f.loops, "has_icc": "color_profile" in f.first, "has_exif": "exif_metadata" in f.first, "has_xmp": "xmp_metadata" in f.first, "chunks": [c.row() | ({"payload": data[c.start : c.start + c.size]} if payloads else {}) for c in f.chunks], "frames": f.frames}


def arrow_type(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(kind))


def demux(files: DataFrame, key: str, content: str = "content", limits: Limits = Limits(), payloads: bool = False) -> DataFrame:
    """(key, RESULT columns, category) for each file. payloads: each chunk has its bytes too, so nothing is joined to get them."""
    schema = f"{key} {dict(files.dtypes)[key]}, {RESULT.replace(CHUNK, WITH_PAYLOAD) if payloads else RESULT}"
    arrow = arrow_type(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n in arrow.names if n != key]
        for batch in batches:
            rows = [describe(d, limits, payloads) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(key).type), *(pa.array([r.get(n) for r in rows], arrow.field(n).type) for n in names)], schema=arrow)

    return files.select(key, content).mapInArrow(run, schema).withColumn("category", category(F.col("error")))
