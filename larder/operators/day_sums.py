"""Consumption statistics from maintained day sums.

A day sum is the quantity and the number of facts of one (day, item, reason). Every batch
of facts adds a folder of its own sums; deleting items adds a folder that takes their sums
back, so nothing is rewritten and applying a batch twice replaces its own folder. The
statistics add the folders up: they read a row per day, item and reason instead of a row
per fact, and a period prunes the month folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import consumption as C

NAME = "consumption_days"
SCHEMA = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("reason", T.StringType()),
                       T.StructField("qty", T.DecimalType(20, 3)), T.StructField("operations", T.LongType()),
                       T.StructField("day", T.DateType()), T.StructField("batch", T.StringType()),
                       T.StructField("month", T.DateType())])


def day_sums(facts: DataFrame) -> DataFrame:
    """(item_id, reason, qty, operations, day) of a batch of facts."""
    return (facts.groupBy(F.to_date("consumed_at").alias("day"), "item_id", "reason")
            .agg(F.sum("qty").cast("decimal(20,3)").alias("qty"), F.count(F.lit(1)).alias("operations"))
            .select("item_id", "reason", "qty", "operations", "day"))


def _add(sums: DataFrame, root: str, batch: str) -> None:
    (sums.withColumn("month", F.trunc("day", "month").cast("date")).hint("rebalance", "month").sortWithinPartitions("month", "day", "item_id")
     .write.mode("overwrite").partitionBy("month").parquet(f"{root}/{NAME}/batch={batch}"))


def add_facts(facts: DataFrame, root: str, batch: str) -> None:
    """Add the sums of a batch of facts (replaced if the batch is applied again)."""
    _add(day_sums(facts), root, batch)


def take_back(spark: SparkSession, root: str, deleted: DataFrame, batch: str) -> None:
    """Take back the sums of deleted items (column ``item_id``). ``batch`` itself is not
    read, so applying it again gives the same sums."""
    rows = read(spark, root).filter(F.col("batch") != batch)
    gone = _added_up(rows.join(deleted.select("item_id").distinct(), "item_id", "left_semi"))
    _add(gone.select("item_id", "reason", (-F.col("qty")).alias("qty"), (-F.col("operations")).alias("operations"), "day"), root, batch)


def read(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{root}/{NAME}")


def _added_up(rows: DataFrame) -> DataFrame:
    return (rows.groupBy("day", "item_id", "reason")
            .agg(F.sum("qty").cast("decimal(20,3)").alias("qty"), F.sum("operations").alias("operations"))
            .filter("operations > 0"))


def consumption_stats(spark: SparkSession, root: str, inventory: DataFrame, start=None, end=None,
                      group_by: str = "categoria", as_of=None, sort: bool = True) -> DataFrame:
    """``consumption.consumption_stats`` over the day sums."""
    if group_by not in C.GROUPS:
        raise ValueError(f"invalid grouping: {group_by!r}")
    start, end = C.period(start, end, as_of)
    months = F.col("month").between(F.lit(start.replace(day=1)), F.lit(end))
    rows = read(spark, root).filter(months & F.col("day").between(F.lit(start), F.lit(end)))
    return C.stats_of_sums(rows, inventory, C.GROUPS[group_by], (end - start).days + 1, sort)
