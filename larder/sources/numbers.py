"""Small sets of numbers (bucket numbers, calendar days) as one bitmap: the only way the
stored tables bring a set to the driver, bounded at 4 KB whatever the table's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap that the aggregate builds.
BITS = 1 << 15


def small_numbers(df: DataFrame, column: str) -> list[int]:
    """The different values of a column of numbers from 0 to ``BITS - 1`` (nulls left out), sorted."""
    # position 0 is the first bit of bitmap bucket 1: shift numbers from 0 to 1
    position = F.bitmap_bit_position(F.col(column).cast("bigint") + 1)
    row = df.filter(F.col(column).isNotNull()).agg(
        F.bitmap_construct_agg(position).alias("bits"), F.min(column).alias("least"), F.max(column).alias("most")).first()
    if row["least"] is None:
        return []
    if row["least"] < 0 or row["most"] >= BITS:
        raise ValueError(f"{column} holds numbers outside 0 to {BITS - 1}")
    bits = row["bits"]
    return [i for i in range(BITS) if bits[i >> 3] >> (i & 7) & 1]
