"""Deleting items from stored tables: their facts go with them, and only the folders that
hold such facts are rewritten. The day sums say which days those are, so the facts
themselves are read in those folders only."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..sources import tables
from ..sources.numbers import small_numbers
from . import day_sums

EPOCH = dt.date(1970, 1, 1)
FACTS = "consumption"


def _since(day: Column) -> Column:
    return F.datediff(day, F.lit(EPOCH))


def delete_facts(spark: SparkSession, root: str, deleted: DataFrame, batch: str, every: str = "day") -> None:
    """Delete the facts of the items in ``deleted`` (column ``item_id``) from the fact table
    below ``root`` (folders of ``every``, days from 1970 to 2059) and take back their day
    sums as ``batch``.

    Survivors are stored before a folder is replaced, so an attempt that fails on the way
    can be applied again: days already rewritten hold no such fact any more. The day sums
    are corrected last; until then they still name every day."""
    items = stored(deleted.filter(F.col("item_id").isNotNull()).select("item_id").distinct(), "deleted-items")
    sums = day_sums.read(spark, root).filter(F.col("batch") != batch)
    hit = sums.join(items, "item_id", "left_semi").select(tables.folder_day(F.col("day"), every).alias("day"))
    folders = small_numbers(hit.select(_since(F.col("day")).alias("day")), "day")
    undated = not hit.filter(F.col("day").isNull()).isEmpty()
    if not folders and not undated:
        return
    named = F.col("day").isin([EPOCH + dt.timedelta(days=n) for n in folders])
    facts = tables.read_days(spark, root, FACTS)
    left = stored(facts.filter(named | F.col("day").isNull() if undated else named).join(items, "item_id", "left_anti"), "surviving-facts")
    tables.replace_days(left, root, FACTS)
    kept = set(small_numbers(left.select(_since(F.col("day")).alias("day")), "day"))
    for n in folders:
        if n not in kept:
            tables.empty_day(spark, root, FACTS, (EPOCH + dt.timedelta(days=n)).isoformat())
    if undated and left.filter(F.col("day").isNull()).isEmpty():
        tables.empty_day(spark, root, FACTS, tables.NO_DAY)
    day_sums.take_back(spark, root, items, batch)
