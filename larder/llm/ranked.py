"""The first rows of every group, without a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group is dealt into, one after another.
LEVELS = (256, 16)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], deal: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their ``rank`` from 1. A group is dealt
    into parts by the hash of column ``deal``, only the first ``limit`` rows of a part go on
    to the next level, so a task holds a part of a group, or 16 times ``limit`` rows."""
    for parts in LEVELS:
        part = F.pmod(F.xxhash64(F.col(deal)), F.lit(parts))
        dealt = df.withColumn("__part", part)
        dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)))
        df = dealt.filter(F.col("rank") <= limit).drop("__part", "rank")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= limit)
