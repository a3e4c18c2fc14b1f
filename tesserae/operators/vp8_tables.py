"""The three large probability tables of the lossy format, as a parameter.

They are published with the format (RFC 6386, sections 11.5, 13.4 and 13.5) and not kept here: a decoder gets them as a
table of rows (name, position, value), see `read_tables`. Streams that this package writes itself use `formula_tables`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

PLANES, BANDS, CONTEXTS, NODES = 4, 8, 3, 11
COEFFICIENTS = PLANES * BANDS * CONTEXTS * NODES
MODES = 10
SUBBLOCKS = MODES * MODES * (MODES - 1)


@dataclass(frozen=True)
class Tables:
    """coefficients, updates: by plane, band, context, node; subblocks: by mode above, mode to the left, node. Each flat."""

    coefficients: tuple[int, ...]
    updates: tuple[int, ...]
    subblocks: tuple[int, ...]

    def __post_init__(self):
        for name, size in (("coefficients", COEFFICIENTS), ("updates", COEFFICIENTS), ("subblocks", SUBBLOCKS)):
            values = getattr(self, name)
            if len(values) != size or not all(0 <= v <= 255 for v in values):
                raise ValueError(f"{name} must be {size} probabilities")

    @staticmethod
    def planes(flat) -> list:
        """The flat coefficient table as lists by plane, band and context."""
        at = iter(range(0, COEFFICIENTS, NODES))
        return [[[list(flat[k : k + NODES]) for k in (next(at) for _ in range(CONTEXTS))] for _ in range(BANDS)] for _ in range(PLANES)]

    def subblock(self, above: int, left: int) -> tuple[int, ...]:
        k = (above * MODES + left) * (MODES - 1)
        return self.subblocks[k : k + MODES - 1]


def formula_tables(seed: int = 1) -> Tables:
    """Probabilities by rule, for streams written and read with the same ones."""
    some = lambda n, k: tuple(1 + (i * k + seed * 37 + i // 11) % 255 for i in range(n))
    return Tables(some(COEFFICIENTS, 53), some(COEFFICIENTS, 29), some(SUBBLOCKS, 71))


def read_tables(spark: SparkSession, path: str) -> Tables:
    """From CSV lines name,position,value; the names are coefficients, updates and subblocks. At most a few thousand rows."""
    rows = spark.read.csv(path, schema="name string, position int, value int", mode="FAILFAST").collect()
    by = lambda name: tuple(r.value for r in sorted((r for r in rows if r.name == name), key=lambda r: r.position))
    return Tables(by("coefficients"), by("updates"), by("subblocks"))
