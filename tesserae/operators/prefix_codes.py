"""Canonical prefix codes as relations: a row per (image, symbol, length)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LONGEST = 15


def canonical(lengths: DataFrame) -> DataFrame:
    """Adds each symbol's code. A code is what all shorter ones (or equal ones before it) take of the code space."""
    used = lengths.where("len > 0")
    order = Window.partitionBy("img_id").orderBy("len", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.expr(f"shiftright({1 << LONGEST}, cast(len as int))")).over(order), F.lit(0))
    code = F.expr(f"shiftright(taken, cast({LONGEST} - len as int))").cast("long")
    return used.withColumn("taken", taken.cast("long")).select("img_id", "symbol", "len", code.alias("code"))


def complete(lengths: DataFrame) -> DataFrame:
    """Whether each image's lengths fill the code space exactly; a lone symbol must have one bit."""
    used = lengths.where("len > 0").groupBy("img_id").agg(F.sum(F.expr(f"shiftright({1 << LONGEST}, cast(len as int))")).alias("taken"), F.count("*").alias("n"), F.min("len").alias("least"))
    return used.select("img_id", F.when(F.col("n") == 1, F.col("least") == 1).otherwise(F.col("taken") == 1 << LONGEST).alias("complete"))


def value(symbol: Column, extra: Column) -> Column:
    """A length or distance from its prefix symbol and the extra bits read."""
    bits = F.shiftright(symbol - 2, 1)
    return F.when(symbol < 4, symbol + 1).otherwise((symbol % 2 + 2) * F.pow(F.lit(2), bits).cast("long") + extra + 1).cast("long")
