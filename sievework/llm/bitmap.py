"""A set of keys as a broadcast bitmap of bounded size, for filters before an exchange.

A key that is in the set is always hit; one that is not may be, so an exact step follows.
Where the keys outgrow the bitmap it hits more and saves less, but nothing is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import free_name
from sievework.session import stage

#: Bits of a bitmap row (4 KB), and the most rows a bitmap may have: 16 MB.
ROW_BITS, BITMAP_ROWS = 32_768, 4_096


@dataclass(frozen=True)
class Bitmap:
    table: DataFrame
    rows: int

    def _spot(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self.rows * ROW_BITS))

    def marked(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with the boolean column ``name``: whether the 64-bit hash ``key`` is hit."""
        row, bit, bits = (free_name(df, c) for c in ("bitmap_row", "bitmap_bit", "bitmap_bits"))
        spot = self._spot(key)
        met = df.withColumns({row: F.floor(spot / ROW_BITS).cast("int"), bit: (spot % ROW_BITS).cast("int")}).join(
            F.broadcast(self.table.toDF(row, bits)), row, "left")
        byte = F.conv(F.hex(F.substring(bits, F.floor(F.col(bit) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, F.col(bit) % 8) == 1, F.lit(False))
        return met.withColumn(name, hit).drop(row, bit, bits)


def bitmap_of(keys: DataFrame, key: Column, count: int) -> Bitmap:
    """The bitmap of ``count`` keys, sixteen bits to a key as far as the bound allows."""
    rows = 1
    while rows * ROW_BITS < 16 * count and rows < BITMAP_ROWS:
        rows *= 2
    spot = F.pmod(key, F.lit(rows * ROW_BITS))
    table = keys.select(F.floor(spot / ROW_BITS).cast("int").alias("row"), (spot % ROW_BITS).cast("long").alias("bit"))
    return Bitmap(stage(table.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")), "bitmap"), rows)
