"""Running sums and call numbers along a total order, as two-level scans: ranges of the
order (chunks) are summed in parallel, the sums before each chunk are added, and inside a
chunk a window runs over its own rows. No task holds more than a chunk of any key.

The chunks are a table in the shared folder, so they are the same for both levels and
for every attempt of a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

EARLIER = (Window.unboundedPreceding, -1)


def chunked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` cut into ranges of the order, stored, with the range (``_chunk``) and the place
    in it (``_pos``, increasing, with gaps between chunks)."""
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("_chunk", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()), "chunks")


def numbered(df: DataFrame, order: Sequence[str], start: int = 1) -> DataFrame:
    """``df`` with ``seq``, the rank of each row in the order from ``start`` on."""
    placed = chunked(df, *order)
    sizes = placed.groupBy("_chunk").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = Window.orderBy("_chunk").rowsBetween(*EARLIER)   # one row per range
    offsets = sizes.select("_chunk", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, "_chunk").withColumn(
        "seq", F.col("_before") + F.col("_pos") - F.col("_first") + start).drop("_chunk", "_pos", "_first", "_before")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, value: Column) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same key up to and
    with this one. Keys must not be null; the order must be total inside a key."""
    placed = chunked(df.withColumn("_value", value), *keys, *order)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*EARLIER)   # one row per range of a key
    offsets = (placed.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
               .select(*keys, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(offsets, [*keys, "_chunk"]).withColumn(
        name, F.col("_before") + F.sum("_value").over(inside)).drop("_chunk", "_pos", "_value", "_before")
