"""Driver tables (TPC-H-like parquet) mapped onto the four canonical tables, and
command frames derived from them.

Only the columns each mapping needs are read, so the parquet scans prune columns;
every mapping is a projection, which keeps the scan's partitioning.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S

# Fixed parameters of the mapping (test-data conventions, not business rules).
STOCK_AS_OF = dt.date(2024, 1, 15)
INVENTORY_CREATED = dt.datetime(2024, 1, 1)
OPENED_BASE = dt.date(2023, 12, 30)
SYSTEM_USER = "system"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table ``name``, listed anew for every query that is built."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def _mod(col: str, k: int) -> Column:
    return F.pmod(F.col(col), F.lit(k))


def unit_of(key: Column) -> Column:
    m = F.pmod(key, F.lit(4))
    return (F.when(m == 0, "PEZZI").when(m == 1, "KG").when(m == 2, "LITRI").otherwise("GRAMMI"))


def category_of(p_type: Column) -> Column:
    return _case(p_type, {"ECONOMY": "LATTICINI", "LARGE": "VERDURE", "MEDIUM": "FRUTTA",
                          "PROMO": "CARNE", "SMALL": "PESCE"}, "CONSERVE")


def location_of(p_size: Column) -> Column:
    m = F.pmod(p_size, F.lit(4))
    return F.when(m == 0, "FRIGO").when(m == 1, "FREEZER").when(m == 2, "DISPENSA").otherwise("CANTINA")


def inventory_from_part(part: DataFrame) -> DataFrame:
    """``part`` as the stock table ``inventory``."""
    key = F.col("p_partkey")
    return part.select(
        key.cast("bigint").alias("item_id"),
        F.col("p_name").alias("name"),
        F.when(_mod("p_partkey", 13) == 0, F.lit(0)).otherwise(F.col("p_size"))
        .cast(S.QTY).alias("quantity"),
        unit_of(key).alias("unit"),
        F.when(_mod("p_partkey", 11) == 0, F.lit(None).cast("date"))
        .otherwise(F.date_add(F.lit(STOCK_AS_OF), (_mod("p_partkey", 41) - 10).cast("int")))
        .alias("expiry_date"),
        F.date_add(F.lit(OPENED_BASE), _mod("p_partkey", 5).cast("int")).alias("opened_date"),
        category_of(F.col("p_type")).alias("category"),
        location_of(F.col("p_size")).alias("location"),
        F.col("p_retailprice").cast(S.PRICE).alias("price"),
        F.when(_mod("p_partkey", 7) == 0, F.lit(None).cast("string"))
        .otherwise(F.col("p_brand")).alias("supplier"),
        F.lit(None).cast("string").alias("lot"),
        F.lit(INVENTORY_CREATED).cast("timestamp_ntz").alias("created_at"),
        F.lit(INVENTORY_CREATED).cast("timestamp_ntz").alias("updated_at"),
        F.lit(SYSTEM_USER).alias("updated_by"),
    )


def reason_of(flag: Column) -> Column:
    return F.when(flag == "A", "CONSUMATO").when(flag == "N", "SCADUTO").otherwise("BUTTATO")


def consumption_from_lineitem(lineitem: DataFrame, with_order_keys: bool = False) -> DataFrame:
    """``lineitem`` as consumption facts. ``lineitem`` has no unique key; the
    ``consumption_id`` built here (order key * 16 + line number) repeats, and the
    quality checks report it."""
    cols = [
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).cast("bigint").alias("consumption_id"),
        F.col("l_partkey").cast("bigint").alias("item_id"),
        F.col("l_quantity").cast(S.QTY).alias("qty"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("consumed_at"),
        reason_of(F.col("l_returnflag")).alias("reason"),
        F.lit(None).cast("string").alias("note"),
    ]
    if with_order_keys:
        cols += [F.col("l_orderkey"), F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                 F.col("l_suppkey"), F.col("l_extendedprice")]
    return lineitem.select(*cols)


# Ledger order of the lineitem-derived consumption commands (lineitem has no unique
# key). The last column, the reason, is the only other field of a request that can
# change an outcome (a discard refuses CONSUMATO), so rows equal in all of these
# are identical requests, interchangeable, and the order is the same on every task
# attempt.
LINEITEM_LEDGER_ORDER = ("consumed_at", "l_orderkey", "l_linenumber", "l_suppkey", "qty", "l_extendedprice",
                         "reason")


def consume_commands_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Every ``lineitem`` row as a consume request: item, quantity, reason, a forced
    flag on one order in ten, and its own call time; ordered by ``LINEITEM_LEDGER_ORDER``."""
    return lineitem.select(
        F.col("l_partkey").cast("bigint").alias("item_id"),
        F.col("l_quantity").cast(S.QTY).alias("qty"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("consumed_at"),
        reason_of(F.col("l_returnflag")).alias("reason"),
        F.lit(None).cast("string").alias("note"),
        (F.pmod(F.col("l_orderkey"), F.lit(10)) == 0).alias("force"),
        F.concat(F.lit("user_"), F.pmod(F.col("l_suppkey"), F.lit(5)).cast("string")).alias("actor"),
        F.col("l_orderkey"),
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.col("l_suppkey"),
        F.col("l_extendedprice"),
    )


def task_from_orders(orders: DataFrame) -> DataFrame:
    """``orders`` as the ``task`` table."""
    key = F.col("o_orderkey")
    cust_m = F.pmod(F.col("o_custkey"), F.lit(5))
    prio = F.col("o_orderpriority")
    return orders.select(
        key.cast("bigint").alias("task_id"),
        F.concat(F.lit("Order "), key.cast("string")).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.when(prio.isin("1-URGENT", "2-HIGH"), "ALTA").when(prio == "3-MEDIUM", "MEDIA")
        .otherwise("BASSA").alias("priority"),
        F.when(_mod("o_orderkey", 17) == 0, "ANNULLATO").when(F.col("o_orderstatus") == "O", "DA_FARE")
        .when(F.col("o_orderstatus") == "P", "IN_CORSO").otherwise("COMPLETATO").alias("status"),
        F.when(_mod("o_orderkey", 9) == 0, F.lit(None).cast("date"))
        .otherwise(F.date_add(F.to_date(F.col("o_orderdate")), _mod("o_orderkey", 30).cast("int")))
        .alias("due_date"),
        F.when(cust_m == 0, F.lit(None).cast("string")).when(cust_m == 1, F.lit(S.UNASSIGNED))
        .otherwise(F.concat(F.lit("user_"), cust_m.cast("string"))).alias("assignee"),
        (_mod("o_orderkey", 5) == 0).alias("recurring"),
        F.when(_mod("o_orderkey", 5) != 0, F.lit(None).cast("string"))
        .when(_mod("o_orderkey", 15) == 0, "GIORNALIERA")
        .when(_mod("o_orderkey", 15) == 5, "SETTIMANALE").otherwise("MENSILE").alias("frequency"),
        F.lit(SYSTEM_USER).alias("created_by"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.lit(SYSTEM_USER).alias("updated_by"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"),
        F.lit(None).cast("bigint").alias("parent_task_id"),
    )


def audit_from_events(events: DataFrame) -> DataFrame:
    """``events`` as the audit log."""
    return events.select(
        F.col("event_id").cast("bigint").alias("log_id"),
        F.col("event_type").alias("op_type"),
        F.lit("events").alias("table_name"),
        F.col("event_id").cast("bigint").alias("record_id"),
        F.col("props").alias("details"),
        F.col("user_id").cast("string").alias("actor"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
    )


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The canonical tables over one driver folder."""
    return {
        "inventory": inventory_from_part(read_table(spark, sf_dir, "part")),
        "consumption": consumption_from_lineitem(read_table(spark, sf_dir, "lineitem")),
        "task": task_from_orders(read_table(spark, sf_dir, "orders")),
        "audit_log": audit_from_events(read_table(spark, sf_dir, "events")),
    }
