"""Relations of images, pixels and planes made by formula from the driver tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import byte_at
from ..operators import container as C
from ..operators.alpha import filtered, unfilter_ragged
from ..operators.vp8 import FULL_MODES, SUBBLOCK_MODES
from ..operators.vp8_frame import Macroblock, write_frame
from ..operators.vp8_header import write_header
from ..operators.vp8_tables import formula_tables
from ..operators.vp8l import write_image, write_stream

FACTOR = 2654435761
MASK = 0xFFFFFFFF


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def images(spark: SparkSession, d: str) -> DataFrame:
    """A header-only lossless file per part."""
    img = read(spark, d, "part").select(F.col("p_partkey").alias("img_id"), F.col("p_size").cast("long").alias("w"), (F.col("p_partkey") % 64 + 1).alias("h"), (F.col("p_partkey") % 2 == 1).alias("alpha"))
    payload = C.vp8l_header(F.col("w"), F.col("h"), F.col("alpha"))
    return img.withColumn("payload", payload).withColumn("content", C.riff(C.chunk("VP8L", payload)))


def hashed(key, n: int):
    return (F.lit(FACTOR) * (key + n)).bitwiseAND(F.lit(MASK))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """8 by 8 pixels per part."""
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("img_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("i"))
    return rows.select("img_id", "i", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), hashed(F.col("img_id") * 64 + F.col("i"), 1).alias("argb"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """2 by 2 block values per part."""
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("img_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
    return rows.select("img_id", (F.col("k") % 2).alias("bx"), F.floor(F.col("k") / 2).alias("by"), hashed(F.col("img_id") * 64 + F.col("k"), 1000003).alias("argb"))


def palettes(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("img_id"), F.explode(F.expr("sequence(0L, p_partkey % 256)")).alias("idx"))
    return rows.select("img_id", "idx", hashed(F.col("img_id") * 256 + F.col("idx"), 7).alias("argb"))


def dealt(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """By number of tasks, not by size: an image costs milliseconds and its key a few bytes."""
    return rows.repartition(4 * spark.sparkContext.defaultParallelism, key)


def unfiltered(spark: SparkSession, d: str, kind: int, width: int = 32) -> DataFrame:
    """Each document's bytes as a filtered plane, and what comes of it: img_id, its size and a weighted sum of its samples."""
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("img_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = [unfilter_ragged(x, width, kind).astype(np.int64) for x in batch.column(1).to_pylist()]
            sums = [int((p * np.arange(1, len(p) + 1)).sum()) for p in planes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) for p in planes], pa.int64()), pa.array(sums, pa.int64())], names=["img_id", "n", "weighted"])

    return rows.mapInArrow(run, "img_id long, n long, weighted long")


#: How stream number i is written: i modulo the length of each.
TRANSFORMS = ((), ("green",), ("palette",), ("predictor",), ("color",), ("predictor", "color", "green"), ("palette", "predictor"), ("green", "color", "predictor"))
COLORS, CACHES, GROUPS = (2, 4, 16, 200, 4096, 1), (0, 7, 0, 11, 1), (0, 0, 2, 3)


def stream_size(i: int, w: int) -> tuple[int, int]:
    return (128, 128) if i % 500 == 0 else (w, i % 64 + 1)


def stream_image(i: int, w: int, h: int) -> np.ndarray:
    """Patches of few colours, or for some all pixels unlike."""
    y, x = np.mgrid[:h, :w]
    shade = x + y * w if i % 7 == 0 and i % 8 not in (2, 6) else (x // 3 + 5 * (y // 2)) % COLORS[i % 6]
    return (FACTOR * (i * 4096 + shade + 1)) & MASK


def stream_files(spark: SparkSession, d: str) -> DataFrame:
    """A lossless file per part with transforms, copies, colour caches, several prefix groups and packed palettes."""
    rows = dealt(spark, read(spark, d, "part").select(F.col("p_partkey").alias("img_id"), F.col("p_size").cast("long").alias("w")), "img_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w, h = stream_size(i, size)
                made.append(write_stream(stream_image(i, w, h), TRANSFORMS[i % 8], CACHES[i % 5], GROUPS[i % 4], 2 + i % 3, seed=i))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["img_id", "payload"])

    made = rows.mapInArrow(run, "img_id long, payload binary")
    return made.select("img_id", "payload", C.riff(C.chunk("VP8L", F.col("payload"))).alias("content"))


def packed_alpha(spark: SparkSession, d: str) -> DataFrame:
    """An alpha plane per part, filtered as img_id % 4 says and packed as a headerless lossless stream."""
    rows = dealt(spark, read(spark, d, "part").select(F.col("p_partkey").alias("img_id"), F.col("p_size").cast("int").alias("width"), (F.col("p_partkey") % 64 + 1).cast("int").alias("height")), "img_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, w, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y, x = np.mgrid[:h, :w]
                plane = filtered((i * 7 + x // 2 * 3 + y * 5) % 256, i % 4).astype(np.int64)
                made.append(bytes([1 | i % 4 << 2]) + write_stream(plane << 8, TRANSFORMS[i % 3], CACHES[i % 5], header=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(1), batch.column(2)], names=["img_id", "payload", "width", "height"])

    return rows.mapInArrow(run, "img_id long, payload binary, width int, height int")


def frames(spark: SparkSession, d: str, records) -> DataFrame:
    """A lossy frame per part: records(i, columns, rows) gives its macroblocks and what else write_frame takes."""
    rows = dealt(spark, read(spark, d, "part").select(F.col("p_partkey").alias("img_id"), F.col("p_size").cast("long").alias("w")), "img_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = formula_tables()
        for batch in batches:
            made = []
            for i, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = i % 64 + 1
                blocks, more = records(i, (w + 15) >> 4, (h + 15) >> 4)
                made.append(write_frame(w, h, blocks, tables, **more))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["img_id", "payload"])

    return rows.mapInArrow(run, "img_id long, payload binary")


def flat_records(i: int, columns: int, rows: int) -> tuple[list, dict]:
    """Each macroblock carries on from its left (odd i) or upper neighbour and adds one step to all of its samples."""
    out = []
    for r in range(rows):
        for c in range(columns):
            k, chroma = (i * 7 + 3 * r + 5 * c) % 7 - 3, (i + r + c) % 3 - 1
            mode = "horizontal" if i % 2 else "vertical"
            blocks = {0: [k] + [0] * 15} if k else {}
            if chroma:
                blocks |= {b: [chroma if b < 21 else -chroma] + [0] * 15 for b in range(17, 25)}
            out.append(Macroblock(mode, mode, skip=not blocks, coefficients=blocks))
    return out, {"base_q": i % 128, "log2_parts": i % 4}


def mixed_records(i: int, columns: int, rows: int) -> tuple[list, dict]:
    """All modes, segments and skips by rule, with values of all sizes."""
    out = []
    for at in range(columns * rows):
        luma = (*FULL_MODES, "subblocks")[(i + at) % 5]
        own = tuple(SUBBLOCK_MODES[(i * 3 + 7 * at + k * 5) % 10] for k in range(16)) if luma == "subblocks" else ()
        m = Macroblock(luma, FULL_MODES[(i + 2 * at) % 4], own, (i + at) % 4, (i + at) % 3 == 0)
        if not m.skip:
            for b in range(25):
                if b % 5 == i % 5 and not (b == 0 and luma == "subblocks"):
                    values = [((i * 31 + at * 17 + b * 5 + k * 3) % 9 - 4) * (1 + (i % 500 if k == 7 else 0)) for k in range(16)]
                    values[0] = 0 if 0 < b < 17 and luma != "subblocks" else values[0]
                    if any(values):
                        m.coefficients[b] = values
        out.append(m)
    return out, {"segments": [10, 40, 70, 127], "map_probs": [100, 30, 255], "base_q": i % 128, "log2_parts": i % 4, "updates": {i % 1056: 77, (i * 7) % 1056: 200}}


def lossless_files(spark: SparkSession, d: str) -> DataFrame:
    """A complete 8 by 8 lossless file per part, written from the pixels' formula."""
    rows = dealt(spark, read(spark, d, "part").select(F.col("p_partkey").alias("img_id")), "img_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            streams = [write_image((FACTOR * (i * 64 + np.arange(64, dtype=np.int64) + 1) & MASK).reshape(8, 8), subtract_green=i % 2 == 0) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(streams, pa.binary())], names=["img_id", "payload"])

    made = rows.mapInArrow(run, "img_id long, payload binary")
    return made.select("img_id", C.riff(C.chunk("VP8L", F.col("payload"))).alias("content"))


def corrupted(spark: SparkSession, d: str) -> DataFrame:
    """The images' files, damaged as p_partkey % 12 says."""
    img = images(spark, d).withColumn("how", F.col("img_id") % 12)
    c, size = F.col("content"), F.octet_length("content")
    patch = lambda at, hexes: F.overlay(c, F.unhex(F.lit(hexes)), F.lit(at + 1))
    cut = lambda n: F.substring(c, F.lit(1), n)
    exif = C.riff(C.chunk("VP8X", C.vp8x(F.col("w"), F.col("h"), F.lit(False), F.col("alpha"), F.lit(True), F.lit(False), F.lit(False))), C.chunk("VP8L", F.col("payload")))
    damaged = (
        F.when(F.col("how") == 1, patch(0, "58")).when(F.col("how") == 2, patch(8, "58")).when(F.col("how") == 3, patch(4, "13")).when(F.col("how") == 4, cut(size - 2)).when(F.col("how") == 5, F.concat(c, F.unhex(F.lit("00"))))
        .when(F.col("how") == 6, patch(25, "01")).when(F.col("how") == 7, C.riff(C.chunk("VP8L", F.col("payload")), C.chunk("VP8L", F.col("payload")))).when(F.col("how") == 8, exif)
        .when(F.col("how") == 9, patch(20, "2e")).when(F.col("how") == 10, F.overlay(c, C.le_bytes(byte_at(c, 24).bitwiseOR(F.lit(32)), 1), F.lit(25))).when(F.col("how") == 11, cut(F.lit(11))).otherwise(c)
    )
    return img.select("img_id", "how", damaged.alias("content"))


def animations(spark: SparkSession, d: str) -> DataFrame:
    """An animated file per user, a frame per event."""
    e = F.col("event_id")
    w, h = e % 32 + 1, e % 24 + 1
    head = F.concat(C.le_bytes(e % 16, 3), C.le_bytes(e % 8, 3), C.le_bytes(w - 1, 3), C.le_bytes(h - 1, 3), C.le_bytes(e % 16777216, 3), C.le_bytes(e % 4, 1))
    frames = read(spark, d, "events").select("user_id", "event_id", C.chunk("ANMF", F.concat(head, C.chunk("VP8L", C.vp8l_header(w, h, F.lit(True))))).alias("frame"))
    per_user = frames.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "frame"))), lambda x: F.hex(x["frame"])).alias("frames"))
    body = F.unhex(F.array_join("frames", ""))
    canvas = F.lit(64)
    return per_user.select("user_id", C.riff(C.chunk("VP8X", C.vp8x(canvas, canvas, F.lit(False), F.lit(True), F.lit(False), F.lit(False), F.lit(True))), C.chunk("ANIM", F.unhex(F.lit("010203040500"))), body).alias("content"))


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Each document as the metadata of a 1 by 1 image: text, source and language."""
    docs = read(spark, d, "documents").select("doc_id", "text", "source", "lang")
    one = F.lit(1).cast("long")
    payload = C.vp8l_header(one, one, F.lit(False))
    part = lambda c: F.encode(F.col(c), "UTF-8")
    none = F.lit(None).cast("binary")
    return docs.select("doc_id", C.static_image(payload, F.lit(True), one, one, F.lit(False), part("lang"), none, part("source"), part("text")).alias("content"))


def alpha_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Each document's bytes as a raw alpha payload, filtered as doc_id % 4 says; 64 wide where that divides."""
    rows = read(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = next(n for n in (64, 16, 7, 3, 2, 1) if len(data) % n == 0)
                plane = filtered(np.frombuffer(data, np.uint8).reshape(-1, w), i % 4)
                out.append((i, bytes([i % 4 << 2]) + plane.tobytes(), w, len(data) // w))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "payload", "width", "height"])

    return rows.mapInArrow(run, "doc_id long, payload binary, width int, height int")


def frame_headers(spark: SparkSession, d: str) -> DataFrame:
    """A lossy frame header per part."""
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("img_id"), F.col("p_size").cast("long").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                segments = [k % 128, 1, -5, 127] if k % 2 == 0 else None
                made.append(write_header(w, k % 64 + 1, segments, k % 64, k % 8, k % 4, k % 128, [k % 16, -(k % 7), 0, 3, -15]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["img_id", "payload"])

    return rows.mapInArrow(run, "img_id long, payload binary")


def partitioned_frames(spark: SparkSession, d: str) -> DataFrame:
    """A frame header per part with its coefficient partitions behind it; every eleventh lacks the last one."""
    rows = frame_headers(spark, d).select("img_id", "payload", F.expr("shiftleft(1L, cast(img_id % 4 as int))").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k, head, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [bytes([(k + p) % 256]) * ((k * 7 + p * 13) % 50 + 1) for p in range(n)]
                sizes = b"".join(len(p).to_bytes(3, "little") for p in parts[:-1])
                made.append(head + sizes + b"".join(parts[:-1] if k % 11 == 0 else parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["img_id", "payload"])

    return rows.mapInArrow(run, "img_id long, payload binary")
