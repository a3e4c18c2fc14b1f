"""Column builders for bytes and wrapping integers. All arithmetic is in BIGINT; nothing leaves code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(data: Column, offset: Column | int) -> Column:
    """The byte at an offset from 0, as a long; null past the end."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.conv(F.nullif(F.hex(F.substring(data, at + 1, F.lit(1))), F.lit("")), 16, 10).cast("long")


def _swapped(hexes: Column, width: int) -> Column:
    """The hex of that many bytes in the other order. One reference to its input keeps nested expressions small."""
    return F.regexp_replace(hexes, "(..)" * width, "".join(f"${k}" for k in range(width, 0, -1)))


def le_uint(data: Column, offset: Column | int, width: int) -> Column:
    """An unsigned little-endian integer of `width` bytes; null past the end."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    hexes = F.hex(F.substring(data, at + 1, F.lit(width)))
    return F.when(F.octet_length(data) >= at + width, F.conv(_swapped(hexes, width), 16, 10).cast("long"))


def le_bytes(value: Column, width: int) -> Column:
    """The little-endian bytes of an unsigned value that fits."""
    return F.unhex(_swapped(F.lpad(F.hex(value.cast("long")), 2 * width, "0"), width))


def text_bytes(text: str) -> Column:
    return F.unhex(F.lit(text.encode().hex()))


def wrap_signed(value: Column, bits: int) -> Column:
    """Two's complement of that many bits."""
    half = 1 << (bits - 1)
    return (value + F.lit(half)).bitwiseAND(F.lit((1 << bits) - 1)) - F.lit(half)


def clamp_byte(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), value))


def low_byte(value: Column) -> Column:
    return value.bitwiseAND(F.lit(255))


def channel(argb: Column, name: str) -> Column:
    return low_byte(F.shiftright(argb, {"a": 24, "r": 16, "g": 8, "b": 0}[name]))


def argb(a: Column, r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 24) + F.shiftleft(r.cast("long"), 16) + F.shiftleft(g.cast("long"), 8) + b.cast("long")
