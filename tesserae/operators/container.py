"""RIFF container fields and writers as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bits import byte_at, le_bytes, le_uint, text_bytes

# Four-character tags and their kinds.
KINDS = {"VP8 ": "lossy_bitstream", "VP8L": "lossless_bitstream", "VP8X": "extended_header", "ALPH": "alpha", "ANIM": "animation", "ANMF": "animation_frame", "ICCP": "color_profile", "EXIF": "exif_metadata", "XMP ": "xmp_metadata"}
PAYLOAD_MAX = 0xFFFFFFF6
#: Of a first partition's length, in a frame tag.
LENGTH_BITS = 19


def is_webp(data: Column) -> Column:
    """Length and both signatures, nothing else."""
    return (F.octet_length(data) >= 12) & (F.substring(data, F.lit(1), F.lit(4)) == text_bytes("RIFF")) & (F.substring(data, F.lit(9), F.lit(4)) == text_bytes("WEBP"))


def riff_status(data: Column) -> Column:
    """The first fault of the 12-byte header, or null."""
    size = le_uint(data, 4, 4)
    return (
        F.when(F.octet_length(data) < 12, "InputTooSmall")
        .when(F.substring(data, F.lit(1), F.lit(4)) != text_bytes("RIFF"), "InvalidRiffSignature")
        .when(F.substring(data, F.lit(9), F.lit(4)) != text_bytes("WEBP"), "InvalidWebPSignature")
        .when(size > PAYLOAD_MAX, "FileTooLarge")
        .when((size < 4) | (size % 2 == 1), "InvalidRiffSize")
    )


def riff_payload_size(data: Column) -> Column:
    return F.when(riff_status(data).isNull(), le_uint(data, 4, 4))


def kind_of(tag: Column) -> Column:
    out = None
    for t, kind in KINDS.items():
        out = (F if out is None else out).when(tag == t, kind)
    return out.otherwise("unknown")


def padded(size: Column) -> Column:
    return size + size.bitwiseAND(F.lit(1))


def chunk_size(size: Column) -> Column:
    return padded(size) + 8


def payload_of(data: Column, payload_offset: Column, size: Column) -> Column:
    return F.substring(data, (payload_offset + 1).cast("int"), size.cast("int"))


def chunk(tag: Column | str, payload: Column) -> Column:
    """Tag, size, payload and a zero byte after an odd payload."""
    tag = text_bytes(tag) if isinstance(tag, str) else tag
    size = F.octet_length(payload)
    return F.concat(tag, le_bytes(size, 4), payload, F.unhex(F.repeat(F.lit("00"), F.pmod(size, F.lit(2)).cast("int"))))


def riff(*chunks: Column) -> Column:
    body = F.concat(*chunks)
    return F.concat(text_bytes("RIFF"), le_bytes(F.octet_length(body) + 4, 4), text_bytes("WEBP"), body)


def vp8x(width: Column, height: Column, icc: Column, alpha: Column, exif: Column, xmp: Column, animation: Column) -> Column:
    flags = icc.cast("int") * 0x20 + alpha.cast("int") * 0x10 + exif.cast("int") * 0x08 + xmp.cast("int") * 0x04 + animation.cast("int") * 0x02
    return F.concat(le_bytes(flags, 4), le_bytes(width - 1, 3), le_bytes(height - 1, 3))


def vp8x_fields(payload: Column) -> Column:
    flags = byte_at(payload, 0)
    bit = lambda mask: flags.bitwiseAND(F.lit(mask)) != 0
    return F.struct(bit(0x20).alias("icc"), bit(0x10).alias("alpha"), bit(0x08).alias("exif"), bit(0x04).alias("xmp"), bit(0x02).alias("animation"), (le_uint(payload, 4, 3) + 1).alias("width"), (le_uint(payload, 7, 3) + 1).alias("height"))


def vp8l_header(width: Column, height: Column, alpha: Column) -> Column:
    bits = (width - 1).cast("long") + F.shiftleft((height - 1).cast("long"), 14) + F.shiftleft(alpha.cast("long"), 28)
    return F.concat(F.unhex(F.lit("2f")), le_bytes(bits, 4))


def vp8l_fields(payload: Column) -> Column:
    bits = le_uint(payload, 1, 4)
    field = lambda shift, n: F.shiftright(bits, shift).bitwiseAND(F.lit((1 << n) - 1))
    ok = (F.octet_length(payload) >= 5) & (byte_at(payload, 0) == 0x2F) & (field(29, 3) == 0)
    return F.when(ok, F.struct((field(0, 14) + 1).alias("width"), (field(14, 14) + 1).alias("height"), (field(28, 1) == 1).alias("alpha")))


def vp8_header(width: Column, height: Column) -> Column:
    """The shortest header a probe accepts: key frame, shown, no first partition."""
    return F.concat(F.unhex(F.lit("1000009d012a")), le_bytes(width, 2), le_bytes(height, 2))


def vp8_tag(version: Column, first_partition: Column) -> Column:
    """The tag of a key frame that is shown; the length must fit."""
    return le_bytes(version * 2 + 16 + F.shiftleft(first_partition, 5), 3)


def vp8_tag_fields(payload: Column) -> Column:
    tag = le_uint(payload, 0, 3)
    field = lambda shift, n: F.shiftright(tag, shift).bitwiseAND(F.lit((1 << n) - 1))
    return F.struct((field(0, 1) == 0).alias("key_frame"), field(1, 3).alias("version"), (field(4, 1) == 1).alias("shown"), field(5, LENGTH_BITS).alias("first_partition"))


def vp8_fields(payload: Column) -> Column:
    t = vp8_tag_fields(payload)
    w, h = le_uint(payload, 6, 2), le_uint(payload, 8, 2)
    dims = F.struct(w.bitwiseAND(F.lit(0x3FFF)).alias("width"), h.bitwiseAND(F.lit(0x3FFF)).alias("height"), F.shiftright(w, 14).alias("x_scale"), F.shiftright(h, 14).alias("y_scale"))
    ok = (F.octet_length(payload) >= 10) & t["key_frame"] & (t["version"] <= 3) & t["shown"] & (t["first_partition"] < F.octet_length(payload)) & (F.substring(payload, F.lit(4), F.lit(3)) == F.unhex(F.lit("9d012a")))
    return F.when(ok, dims)


def alpha_fields(payload: Column) -> Column:
    b = byte_at(payload, 0)
    field = lambda shift: F.shiftright(b, shift).bitwiseAND(F.lit(3))
    return F.struct(field(0).alias("compression"), field(2).alias("filter"), field(4).alias("preprocessing"), field(6).alias("reserved"))


def alpha_payload_ok(payload: Column, pixels: Column) -> Column:
    """As the demuxer sees it: reserved bits don't matter, raw data must be exactly as long as the plane."""
    f = alpha_fields(payload)
    return (F.octet_length(payload) >= 2) & (f["compression"] <= 1) & (f["preprocessing"] <= 1) & ((f["compression"] != 0) | (F.octet_length(payload) == pixels + 1))


def pixel_count_status(width: Column, height: Column) -> Column:
    return F.when((width == 0) | (height == 0), "InvalidCanvasSize").when(width.cast("long") * height.cast("long") > 0xFFFFFFFF, "DimensionsOverflow")


def inside(x: Column, y: Column, w: Column, h: Column, canvas_w: Column, canvas_h: Column) -> Column:
    return (w > 0) & (h > 0) & (x <= canvas_w) & (y <= canvas_h) & (x.cast("long") + w <= canvas_w) & (y.cast("long") + h <= canvas_h)


def static_image(payload: Column, lossless: Column, width: Column, height: Column, has_alpha: Column, icc: Column, alph: Column, exif: Column, xmp: Column) -> Column:
    """A still image file: simple if there is nothing beside the bitstream, else extended. Missing parts are null."""
    extended = icc.isNotNull() | alph.isNotNull() | exif.isNotNull() | xmp.isNotNull()
    part = lambda tag, p: F.when(p.isNotNull(), chunk(tag, p)).otherwise(F.unhex(F.lit("")))
    header = chunk("VP8X", vp8x(width, height, icc.isNotNull(), has_alpha | alph.isNotNull(), exif.isNotNull(), xmp.isNotNull(), F.lit(False)))
    data = F.when(lossless, chunk("VP8L", payload)).otherwise(chunk("VP8 ", payload))
    return F.when(extended, riff(header, part("ICCP", icc), part("ALPH", alph), data, part("EXIF", exif), part("XMP ", xmp))).otherwise(riff(data))
