"""Entity tables stored by a hash bucket of their key.

A write job reads only the buckets that its calls name and rewrites only those whose rows
it changes (dynamic partition overwrite), so one call costs one bucket, whatever the size
of the table. A lookup of a bounded list of keys reads the keys' buckets, and in their
files only row groups whose bloom filter may hold a key.

Applying the same calls again after a crash gives the same table: what a call changes does
not depend on what an earlier attempt wrote (last value of a field, fixed time)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from .numbers import small_numbers

KEY = {"inventory": "item_id", "task": "task_id"}
#: Choose it so that a bucket holds some hundred megabytes.
BUCKETS = 64


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("bigint")), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, name: str, buckets: int, rows_per_group: int | None, **options: str) -> None:
    key = KEY[name]
    writer = (df.select(*S.TABLES[name].fieldNames(), bucket_of(F.col(key), buckets).alias("bucket")).hint("rebalance", "bucket")
              .sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket")
              .option(f"parquet.bloom.filter.enabled#{key}", "true").options(**options))
    if rows_per_group:
        writer = writer.option("parquet.block.row.count.limit", str(rows_per_group))
    writer.parquet(path)


def write(df: DataFrame, root: str, name: str, buckets: int = BUCKETS, rows_per_group: int | None = None) -> None:
    """Write the whole entity table below ``root``, one folder per bucket, sorted by key."""
    _write(df, f"{root}/{name}", name, buckets, rows_per_group)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table with its ``bucket``."""
    return spark.read.schema(T.StructType([*S.TABLES[name].fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{root}/{name}")


def lookup(spark: SparkSession, root: str, name: str, ids: Iterable[int], buckets: int = BUCKETS) -> DataFrame:
    """The rows of the given keys (a list the caller holds). The buckets prune folders, the
    keys reach the scan as a pushed filter."""
    wanted = sorted({int(i) for i in ids})
    keys = spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in wanted]).cast("array<bigint>")).alias("k"))
    homes = small_numbers(keys.select(bucket_of(F.col("k"), buckets).alias("b")), "b") if wanted else []
    return (read(spark, root, name).filter(F.col("bucket").isin(homes) & F.col(KEY[name]).isin(wanted))
            .select(*S.TABLES[name].fieldNames()))


def apply_changes(spark: SparkSession, root: str, name: str, calls: DataFrame, job: Callable[[DataFrame, DataFrame], object],
                  buckets: int = BUCKETS):
    """Apply a job that changes rows in place (an update or a cancel; ``job(table, calls)``
    built with ``store=True``) to the stored table; returns the job's result, whose
    outcomes and audit rows read the stored decisions.

    The table that the job sees is the buckets its calls name: a call on any other key
    would not be found in the whole table either."""
    key = KEY[name]
    named = calls.filter(F.col(key).isNotNull()).select(bucket_of(F.col(key), buckets).alias("b"))
    whole = read(spark, root, name)
    table = whole.filter(F.col("bucket").isin(small_numbers(named, "b"))).select(*S.TABLES[name].fieldNames())
    result = job(table, calls)
    changed = result.outcomes.filter("ok").select(bucket_of(F.col("key"), buckets).alias("b"))
    touched = small_numbers(changed, "b")
    if touched:
        _write(result.table.filter(bucket_of(F.col(key), buckets).isin(touched)), f"{root}/{name}", name, buckets, None,
               partitionOverwriteMode="dynamic")
    return result
