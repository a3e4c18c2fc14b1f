"""Pixel relations: one row a pixel, neighbours by windows, block tables by joins. Kept in code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import argb, channel, clamp_byte, low_byte, wrap_signed

CACHE_FACTOR = 506832829


def subtract_green_inverse(p: Column) -> Column:
    g = channel(p, "g")
    return argb(channel(p, "a"), low_byte(channel(p, "r") + g), g, low_byte(channel(p, "b") + g))


def color_inverse(p: Column, element: Column) -> Column:
    """Signed multipliers of the block's element; blue uses the new red."""
    s8 = lambda v: wrap_signed(v, 8)
    g = channel(p, "g")
    red = low_byte(channel(p, "r") + F.shiftright(s8(channel(element, "b")) * s8(g), 5))
    blue = low_byte(channel(p, "b") + F.shiftright(s8(channel(element, "g")) * s8(g), 5) + F.shiftright(s8(channel(element, "r")) * s8(red), 5))
    return argb(channel(p, "a"), red, g, blue)


def block_lookup(px: DataFrame, blocks: DataFrame, bits: int, name: str = "element") -> DataFrame:
    """Adds each pixel's block value: an equi-join on the image and the shifted coordinates."""
    b = blocks.select("img_id", "bx", "by", F.col("argb").alias(name))
    # block tables grow with the images: sized by rows, never broadcast on a guess
    b = b.hint("merge")
    return px.withColumns({"bx": F.shiftright("x", bits), "by": F.shiftright("y", bits)}).join(b, ["img_id", "bx", "by"])


def palette_deltas(entries: DataFrame) -> DataFrame:
    """Running sums of each channel modulo 256, by palette."""
    w = Window.partitionBy("img_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    sums = [low_byte(F.sum(channel(F.col("argb"), c)).over(w)) for c in "argb"]
    return entries.select("img_id", "idx", argb(*sums).alias("argb"))


def palette_bits(size: Column) -> Column:
    return F.when(size <= 2, 3).when(size <= 4, 2).when(size <= 16, 1).otherwise(0)


def palette_expand(packed: DataFrame, palette: DataFrame) -> DataFrame:
    """Index pixels to colours; what the palette lacks is transparent black."""
    return packed.join(palette.select("img_id", "idx", F.col("argb").alias("color")).hint("merge"), ["img_id", "idx"], "left").withColumn("color", F.coalesce("color", F.lit(0).cast("long")))


def neighbours(px: DataFrame, width: int) -> DataFrame:
    """Adds l, t, tr, tl of the pixel relation, all at fixed distances in one order: past the right edge, the pixel that
    stands a row less one before is the first one of the same row, as the format has it."""
    order = Window.partitionBy("img_id").orderBy("i")
    lag = lambda n: F.lag("argb", n).over(order)
    return px.withColumns({"l": F.when(F.col("x") > 0, lag(1)), "t": lag(width), "tl": F.when(F.col("x") > 0, lag(width + 1)), "tr": F.when(F.col("y") > 0, lag(width - 1))})


def predict_any(mode: Column) -> Column:
    """The prediction of a row of `neighbours`: the first pixel black, the first row from the left, the first column from above."""
    inner = predict(mode, F.col("l"), F.col("t"), F.col("tr"), F.col("tl"))
    return F.when((F.col("x") == 0) & (F.col("y") == 0), F.lit(0xFF000000)).when(F.col("y") == 0, F.col("l")).when(F.col("x") == 0, F.col("t")).otherwise(inner)


def block_dims(size: Column, bits: int) -> Column:
    """How many blocks of that size cover an edge."""
    return F.shiftright(size + ((1 << bits) - 1), bits)


def block_transform_ok(bits: Column, block_size: Column, side_w: Column, side_h: Column, w: Column, h: Column) -> Column:
    """Whether the side image of a predictor or colour transform fits the image."""
    dims = lambda side, edge: side == F.floor((edge + block_size - 1) / block_size)
    return bits.between(2, 9) & (block_size == F.pow(F.lit(2), bits).cast("long")) & dims(side_w, w) & dims(side_h, h)


def palette_transform_ok(size: Column, bits: Column, table_w: Column, table_h: Column, after_w: Column, after_h: Column, w: Column, h: Column) -> Column:
    """Whether a palette's width, packing and the packed image fit together."""
    scale = F.pow(F.lit(2), bits).cast("long")
    return size.between(1, 256) & (bits == palette_bits(size)) & (table_w == size) & (table_h == 1) & (after_w == F.floor((w + scale - 1) / scale)) & (after_h == h)


def channel_count(order: Column) -> Column:
    """Of an output format: rgb, rgba, bgra or argb."""
    return F.when(order == "rgb", 3).when(order.isin("rgba", "bgra", "argb"), 4)


def row_bytes(width: Column, order: Column) -> Column:
    """Bytes of a packed row; null above 32 bits, see buffer_status."""
    n = width.cast("long") * channel_count(order)
    return F.when(n <= 0xFFFFFFFF, n)


def buffer_status(width: Column, height: Column, stride: Column, order: Column, length: Column) -> Column:
    """The first fault of an output buffer, or null."""
    row = row_bytes(width, order)
    sized = F.when((width == 0) | (height == 0), "InvalidCanvasSize").when(width.cast("long") * height.cast("long") > 0xFFFFFFFF, "DimensionsOverflow")
    return sized.when(row.isNull() | (stride < row) | (stride.cast("long") * (height - 1) + row > length), "OutputTooLarge")


def _each(f, *pixels: Column) -> Column:
    return argb(*[f(*[channel(p, c) for p in pixels]) for c in "argb"])


def _mean(a: Column, b: Column) -> Column:
    return _each(lambda x, y: F.shiftright(x + y, 1), a, b)


def predict(mode: Column, left: Column, top: Column, right: Column, corner: Column) -> Column:
    """The prediction of an inner pixel by its block's mode."""
    spread = lambda a, b: sum((F.abs(channel(a, c) - channel(b, c)) for c in "argb"), F.lit(0))
    half = lambda m, c: clamp_byte(m + F.when(m >= c, F.shiftright(m - c, 1)).otherwise(-F.shiftright(c - m, 1)))
    values = [
        F.lit(0xFF000000), left, top, right, corner, _mean(_mean(left, right), top), _mean(left, corner), _mean(left, top), _mean(corner, top), _mean(top, right), _mean(_mean(left, corner), _mean(top, right)),
        F.when(spread(top, corner) < spread(left, corner), left).otherwise(top), _each(lambda a, t, c: clamp_byte(a + t - c), left, top, corner), _each(half, _mean(left, top), corner),
    ]
    out = None
    for m, v in enumerate(values):
        out = (F if out is None else out).when(mode == m, v)
    return out


def cache_slot(p: Column, bits: int) -> Column:
    return F.shiftright((F.lit(CACHE_FACTOR) * p).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - bits)


def swizzled(p: Column, order: str) -> Column:
    """A pixel's bytes as lower-case hex."""
    return F.lower(F.concat(*[F.lpad(F.hex(channel(p, c)), 2, "0") for c in order]))
