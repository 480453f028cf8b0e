"""Reading and writing the four canonical tables.

* Reads use the declared ``StructType`` (no inference) and let the parquet reader
  prune columns and take pushed filters.
* The fact tables (``consumption``, ``audit_log``) are append-only and written
  partitioned by day of their timestamp, so period filters prune whole folders.
* ``inventory`` and ``task`` are rewritten as a new snapshot (a new folder per
  version): Spark cannot overwrite a path it is reading, and a failed job leaves
  the previous version intact.
* Every file is sorted by its key inside its task (facts by day, then item), a
  sort with no shuffle: parquet row groups then cover narrow key ranges, and a
  lookup by id skips the row groups whose min/max exclude it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

FACT_DAY = {"consumption": "consumed_at", "audit_log": "ts"}
SORT_KEY = {"inventory": ("item_id",), "task": ("task_id",), "consumption": ("day", "item_id"),
            "audit_log": ("day", "log_id")}


def read(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A canonical table under ``root`` (a snapshot version for the entity tables)."""
    path = f"{root}/{name}" + (f"/version={version}" if version else "")
    schema = S.TABLES[name]
    if name in FACT_DAY:
        # a new StructType: ``StructType.add`` would change the shared one in place
        schema = T.StructType(schema.fields + [T.StructField("day", T.DateType())])
    return spark.read.schema(schema).parquet(path).select(*S.TABLES[name].fieldNames())


#: The folder of rows without a time.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def read_days(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A fact table with its ``day``."""
    return spark.read.schema(T.StructType([*S.TABLES[name].fields, T.StructField("day", T.DateType())])).parquet(f"{root}/{name}")


def replace_days(df: DataFrame, root: str, name: str) -> None:
    """Replace the day folders that ``df`` has rows of; every other folder keeps its files."""
    (df.select(*S.TABLES[name].fieldNames(), "day").hint("rebalance", "day").sortWithinPartitions(*SORT_KEY[name])
     .write.mode("overwrite").partitionBy("day").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/{name}"))


def empty_day(spark: SparkSession, root: str, name: str, day: str) -> None:
    """Leave a day folder without rows (an overwrite of partitions replaces only those that
    get rows)."""
    spark.createDataFrame([], S.TABLES[name]).write.mode("overwrite").parquet(f"{root}/{name}/day={day}")


def folder_day(day: Column, every: str) -> Column:
    """The first day of the stretch (``day``, ``month``, ``year``) that a folder holds."""
    return F.to_date(day) if every == "day" else F.trunc(day, every).cast("date")


def append_facts(df: DataFrame, root: str, name: str, batch: str | None = None, every: str = "day") -> None:
    """Append rows to a fact table, one folder per day (or month, for sparse days; the
    folder is named by the first day); with ``batch``, below a folder of
    that batch, which a rerun of the batch replaces (a table is written either way, not
    both). Rows are first rebalanced by day
    (AQE splits big days and merges small ones), so the number of files follows the days
    and the bytes, not tasks times days."""
    if name not in FACT_DAY:
        raise ValueError(f"{name} is not a fact table")
    cols = S.TABLES[name].fieldNames()
    (df.select(*cols, folder_day(F.col(FACT_DAY[name]), every).alias("day")).hint("rebalance", "day")
     .sortWithinPartitions(*SORT_KEY[name])
     .write.mode("append" if batch is None else "overwrite").partitionBy("day")
     .parquet(f"{root}/{name}" + (f"/batch={batch}" if batch is not None else "")))


def write_snapshot(df: DataFrame, root: str, name: str, version: str) -> str:
    """Write a version of an entity table (a rerun replaces it); returns its path."""
    if name in FACT_DAY:
        raise ValueError(f"{name} is append-only")
    path = f"{root}/{name}/version={version}"
    (df.select(*S.TABLES[name].fieldNames()).sortWithinPartitions(*SORT_KEY[name])
     .write.mode("overwrite").parquet(path))
    return path


def write_json_lines(docs: DataFrame, path: str, col: str = "json") -> None:
    """The JSON document sink: one document per line."""
    docs.select(col).write.mode("errorifexists").text(path)
