"""Consumption statistics over a period: by category, by reason, or one total.

The period is a half-open timestamp range on ``consumed_at`` so it reaches the
parquet scan as pushed filters (and prunes day partitions of a partitioned fact
table). By category, the facts are summed per item *before* the join with the
inventory: the join then sees at most one row per item, and a hot item is
collapsed by the map-side partial aggregate instead of skewing the join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expressions as X

# The grouping names the statistics accept (and English aliases).
GROUPS = {"categoria": "category", "motivo": "reason", "totale": "total",
          "category": "category", "reason": "reason", "total": "total"}


def _as_date(d) -> dt.date:
    return dt.date.fromisoformat(d) if isinstance(d, str) else d


def period(start, end, as_of) -> tuple[dt.date, dt.date]:
    """The period asked for: the end is ``as_of`` unless given, the start thirty days
    before the end unless given (both included, 31 calendar days). Nothing reads the
    clock: one of ``end`` and ``as_of`` is needed."""
    if end is None and as_of is None:
        raise ValueError("give the end of the period or the reference date")
    end = _as_date(as_of if end is None else end)
    return (end - dt.timedelta(days=30) if start is None else _as_date(start)), end


def in_period(df: DataFrame, col: str, start, end) -> DataFrame:
    """``CAST(col AS DATE) BETWEEN start AND end`` as a pushed-down range."""
    start, end = _as_date(start), _as_date(end)
    lo = X.ts_lit(dt.datetime.combine(start, dt.time()))
    hi = X.ts_lit(dt.datetime.combine(end + dt.timedelta(days=1), dt.time()))
    return df.filter((F.col(col) >= lo) & (F.col(col) < hi))


def _stats(grouped_totals: DataFrame, days: int) -> DataFrame:
    """``total_qty``, ``operations`` and ``daily_mean`` (total / calendar days of the
    period, rounded half-up to 3 places); a null aggregate is shown as 0."""
    mean = F.round(F.try_divide(F.col("total_qty"), F.lit(days).cast("decimal(10,0)")), 3)
    return grouped_totals.select(
        "group_name",
        F.coalesce(F.col("total_qty"), F.lit(0).cast("decimal(20,3)")).alias("total_qty"),
        F.col("operations").cast("bigint").alias("operations"),
        F.coalesce(mean.cast("decimal(20,3)"), F.lit(0).cast("decimal(20,3)")).alias("daily_mean"),
    )


def consumption_stats(consumption: DataFrame, inventory: DataFrame, start=None, end=None,
                      group_by: str = "categoria", as_of=None, sort: bool = True) -> DataFrame:
    """Consumed quantity, number of operations and daily mean per group."""
    if group_by not in GROUPS:
        raise ValueError(f"invalid grouping: {group_by!r}")
    kind = GROUPS[group_by]
    start, end = period(start, end, as_of)
    days = (end - start).days + 1
    facts = in_period(consumption, "consumed_at", start, end)
    return _by_group(facts, inventory, kind, days, sort, F.count(F.lit(1)))


def stats_of_sums(sums: DataFrame, inventory: DataFrame, kind: str, days: int, sort: bool = True) -> DataFrame:
    """The statistics over rows that are already sums (``qty`` and ``operations`` of an item
    and reason)."""
    return _by_group(sums, inventory, kind, days, sort, F.sum("operations"))


def _by_group(rows: DataFrame, inventory: DataFrame, kind: str, days: int, sort: bool, operations: Column) -> DataFrame:
    sums = [F.sum("qty").alias("total_qty"), operations.alias("operations")]
    if kind == "category":
        per_item = rows.groupBy("item_id").agg(*sums).filter("operations > 0")
        joined = per_item.join(inventory.select("item_id", "category"), "item_id")
        totals = joined.groupBy(F.col("category").alias("group_name")).agg(
            F.sum("total_qty").alias("total_qty"), F.sum("operations").alias("operations"))
    elif kind == "reason":
        totals = rows.groupBy(F.col("reason").alias("group_name")).agg(*sums).filter("operations > 0")
    else:
        totals = rows.agg(F.lit(S.TOTAL_GROUP).alias("group_name"), *sums).withColumn("operations", F.coalesce("operations", F.lit(0)))
    out = _stats(totals, days)
    return out.orderBy(F.col("total_qty").desc(), F.col("group_name")) if sort else out


def stats_json(stats: DataFrame, start, end, group_by: str) -> DataFrame:
    """The documents of the statistics answer (``group_name``, ``json``): one for each
    group, and one without a group that has the parameters and the sum over the groups."""
    start, end = _as_date(start), _as_date(end)
    # fixed values: field names of the JSON answer
    group = F.struct(F.col("group_name").alias("gruppo"), F.col("total_qty").cast("double").alias("totale_consumato"),
                     F.col("operations").alias("numero_operazioni"), F.col("daily_mean").cast("double").alias("media_giornaliera"))
    whole = F.struct(F.lit(start.isoformat()).alias("data_inizio"), F.lit(end.isoformat()).alias("data_fine"),
                     F.lit(group_by).alias("raggruppa_per"), F.lit((end - start).days + 1).alias("giorni_periodo"),
                     F.coalesce(F.col("total"), F.lit(0)).cast("double").alias("totale_consumi"))
    nulls = {"ignoreNullFields": "false"}
    return stats.select("group_name", F.to_json(group, nulls).alias("json")).unionByName(
        stats.agg(F.sum("total_qty").alias("total")).select(F.lit(None).cast("string").alias("group_name"), F.to_json(whole, nulls).alias("json")))


def consumption_rollup(consumption: DataFrame, inventory: DataFrame, start=None, end=None,
                       group_by: str = "categoria", as_of=None) -> DataFrame:
    """The groups of ``consumption_stats`` plus the grand total over them, in one
    aggregation (``rollup``); the total row has ``is_total`` true and a null group."""
    stats = consumption_stats(consumption, inventory, start, end, group_by, as_of, sort=False)
    return (stats.rollup("group_name")
            .agg(F.sum("total_qty").alias("total_qty"), F.sum("operations").alias("operations"),
                 F.grouping("group_name").alias("_g"))
            .select("group_name", F.coalesce("total_qty", F.lit(0).cast("decimal(20,3)")).alias("total_qty"),
                    F.coalesce("operations", F.lit(0)).cast("bigint").alias("operations"),
                    (F.col("_g") == 1).alias("is_total")))
