"""Data-quality operators derived from the table rules: per-row violations,
foreign-key orphans, duplicate keys, and the delete cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def _violations(checks: list[tuple[str, Column]]) -> Column:
    """Comma-separated codes of the failed checks (null-safe: a null test passes)."""
    return F.concat_ws(",", *[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks])


def _too_long(col: str) -> Column:
    return F.length(col) > S.MAX_LEN[col]


def inventory_violations(inventory: DataFrame) -> DataFrame:
    """Items that break a rule of the stock table, with the codes they break."""
    checks = [
        ("NAME_MISSING", F.col("name").isNull()),
        ("NAME_TOO_LONG", _too_long("name")),
        ("QUANTITY_INVALID", F.col("quantity").isNull() | (F.col("quantity") < 0)),
        ("UNIT_INVALID", ~F.coalesce(F.col("unit").isin(*S.UNITS), F.lit(False))),
        ("CATEGORY_INVALID", ~F.coalesce(F.col("category").isin(*S.CATEGORIES), F.lit(False))),
        ("LOCATION_INVALID", ~F.coalesce(F.col("location").isin(*S.LOCATIONS), F.lit(False))),
        ("OPENED_BEFORE_CREATED", F.col("opened_date") < F.to_date("created_at")),
        ("PRICE_NEGATIVE", F.col("price") < 0),
        ("SUPPLIER_TOO_LONG", _too_long("supplier")),
        ("LOT_TOO_LONG", _too_long("lot")),
        ("UPDATED_BY_MISSING", F.col("updated_by").isNull()),
    ]
    return (inventory.select("item_id", _violations(checks).alias("violations"))
            .filter(F.col("violations") != ""))


def task_violations(task: DataFrame) -> DataFrame:
    """Tasks that break a rule of the task table, with the codes they break."""
    rec = F.col("recurring")
    freq = F.col("frequency")
    checks = [
        ("TITLE_MISSING", F.col("title").isNull()),
        ("TITLE_TOO_LONG", _too_long("title")),
        ("PRIORITY_INVALID", ~F.coalesce(F.col("priority").isin(*S.PRIORITIES), F.lit(False))),
        ("STATUS_INVALID", ~F.coalesce(F.col("status").isin(*S.STATUSES), F.lit(False))),
        ("FREQUENCY_INVALID", freq.isNotNull() & ~freq.isin(*S.FREQUENCIES)),
        ("RECURRING_WITHOUT_FREQUENCY", rec & freq.isNull()),
        ("FREQUENCY_WITHOUT_RECURRING", ~rec & freq.isNotNull()),
        ("ASSIGNEE_TOO_LONG", _too_long("assignee")),
        ("CREATED_BY_MISSING", F.col("created_by").isNull()),
    ]
    return (task.select("task_id", _violations(checks).alias("violations"))
            .filter(F.col("violations") != ""))


def fk_orphans(inventory: DataFrame, consumption: DataFrame, task: DataFrame) -> DataFrame:
    """References to missing rows: consumption facts of an unknown item, and tasks
    whose parent is unknown. One row per missing key with the number of rows that
    point at it. The referencing side is aggregated per key first, so the anti-join
    sees one row per key whatever the skew."""
    cons = (consumption.groupBy("item_id").agg(F.count(F.lit(1)).alias("rows"))
            .join(inventory.select("item_id"), "item_id", "left_anti")
            .select(F.lit("consumption.item_id").alias("reference"), F.col("item_id").alias("missing_key"), "rows"))
    par = (task.filter(F.col("parent_task_id").isNotNull())
           .groupBy("parent_task_id").agg(F.count(F.lit(1)).alias("rows"))
           .join(task.select(F.col("task_id").alias("parent_task_id")), "parent_task_id", "left_anti")
           .select(F.lit("task.parent_task_id").alias("reference"),
                   F.col("parent_task_id").alias("missing_key"), "rows"))
    return cons.unionByName(par)


def duplicate_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Primary-key values held by more than one row, per table."""
    keys = {"inventory": "item_id", "task": "task_id", "consumption": "consumption_id", "audit_log": "log_id"}
    parts = []
    for name, df in tables.items():
        k = keys[name]
        parts.append(df.groupBy(k).agg(F.count(F.lit(1)).alias("copies"))
                     .filter(F.col("copies") > 1)
                     .select(F.lit(name).alias("table_name"), F.col(k).alias("key"), "copies"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cascade_delete(inventory: DataFrame, consumption: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete the items whose ids are in ``deleted`` (column ``item_id``) and, as the
    foreign key cascades, their consumption facts. Returns the two new tables."""
    return without_items(inventory, deleted), without_items(consumption, deleted)


def without_items(df: DataFrame, deleted: DataFrame) -> DataFrame:
    """The rows whose item is not in ``deleted``."""
    return df.join(deleted.select("item_id").distinct(), "item_id", "left_anti")
