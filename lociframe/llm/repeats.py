"""Which rows' keys occur more than once, as a bitmap of bounded size that any scan can ask."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import own_prefix

#: A bitmap has 2**LEAST bits (one megabyte) or 32 for each key, so one in 32 of other rows is hit at most, up to 2**MOST
#: bits (64 megabytes, for 16 million keys; with more keys more rows are hit), in rows of 2**ROW_BITS.
LEAST, MOST, ROW_BITS = 23, 29, 15


@dataclass(frozen=True)
class Bitmap:
    rows: DataFrame  # (__row, __bits) with the bits of all keys set
    bits: int


def _place(key: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << bits))


def bitmap(keys: DataFrame, count: int) -> Bitmap:
    """The bitmap of all rows of keys, of which there are about count."""
    bits = min(MOST, max(LEAST, math.ceil(math.log2(32 * max(1, count)))))
    place = keys.select(_place([F.col(f"`{c}`") for c in keys.columns], bits).alias("place"))
    rows = place.groupBy(F.shiftright("place", ROW_BITS).alias("__row")).agg(F.expr(f"bitmap_construct_agg(place % {1 << ROW_BITS})").alias("__bits"))
    return Bitmap(rows, bits)


def mark(df: DataFrame, key: list[Column], held: Bitmap, name: str = "__hit") -> DataFrame:
    """df with the column name: false only where the key is none of the bitmap's. No shuffle: the bitmap is broadcast,
    and its size is bounded."""
    p = own_prefix(df)
    place, row, at, bits = (f"{p}{x}" for x in ("place", "row", "at", "bits"))
    placed = df.withColumn(place, _place(key, held.bits)).withColumn(row, F.shiftright(place, ROW_BITS)).withColumn(at, F.col(place) % (1 << ROW_BITS))
    found = placed.join(F.broadcast(held.rows.select(F.col("__row").alias(row), F.col("__bits").alias(bits))), row, "left")
    byte = F.expr(f"cast(conv(hex(substring({bits}, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.col(bits).isNotNull() & (F.getbit(byte, (F.col(at) % 8).cast("int")) == 1)
    return found.withColumn(name, F.coalesce(hit, F.lit(False))).drop(place, row, at, bits)
