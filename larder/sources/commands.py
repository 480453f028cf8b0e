"""Command frames derived from the driver's tables, for the write jobs.

Every row of the source table becomes one call; key arithmetic only plants
faults and picks which optional fields a call sets, it never drops rows. All
derivations over ``orders`` share one call-order space: ``seq = o_orderkey * 8 +
j`` with ``j`` naming the kind of call, so their audit rows can be appended
together. Ids that must not exist are negative.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .adapters import category_of, location_of, unit_of

INSERT_NOW = dt.datetime(2024, 1, 15, 10, 0, 0)
TASK_NOW = dt.datetime(1998, 12, 31, 0, 0, 0)

# j values of the orders-derived call kinds
J_ITEM_UPDATE, J_COMPLETE_A, J_COMPLETE_B, J_CANCEL_A, J_UPDATE_A, J_UPDATE_B, J_CANCEL_B = 0, 1, 2, 3, 4, 5, 6


def _m(col: str | Column, k: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(c, F.lit(k))


def _s(c: Column) -> Column:
    return c.cast("string")


def insert_items_from_part(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    exp = F.date_add(F.lit(dt.date(2024, 1, 15)), (_m(k, 41) - 10).cast("int"))
    return part.select(
        k.cast("bigint").alias("seq"),
        F.concat(F.lit("user_"), _s(_m(k, 3))).alias("actor"),
        F.when(_m(k, 23) == 0, F.lit(None).cast("string")).when(_m(k, 29) == 0, F.repeat(F.lit("n"), 256))
        .otherwise(F.col("p_name")).alias("name"),
        F.when(_m(k, 17) == 0, "0").when(_m(k, 19) == 0, "12345678.9").when(_m(k, 31) == 0, "abc")
        .otherwise(F.concat(_s(F.col("p_size")), F.lit(".25"))).alias("quantity"),
        F.when(_m(k, 37) == 0, "LITRO").otherwise(unit_of(k)).alias("unit"),
        category_of(F.col("p_type")).alias("category"),
        location_of(F.col("p_size")).alias("location"),
        F.when(_m(k, 41) == 0, "2024-02-30").when(_m(k, 43) == 0, "2024-1-5")
        .when(_m(k, 11) == 0, F.lit(None).cast("string"))
        .otherwise(F.date_format(exp, "yyyy-MM-dd")).alias("expiry_date"),
        F.when(_m(k, 47) == 0, "2024-03-01").when(_m(k, 53) == 0, "2024-01-10")
        .when(_m(k, 3) == 0, "2024-01-15").alias("opened_date"),
        F.when(_m(k, 59) == 0, "0").when(_m(k, 61) == 0, "-1.00")
        .otherwise(_s(F.col("p_retailprice").cast("decimal(10,2)"))).alias("price"),
        F.col("p_brand").alias("supplier"),
        F.lit(None).cast("string").alias("lot"),
    )


def update_items_from_orders(orders: DataFrame) -> DataFrame:
    """One update call per order on the item numbered like its customer (so an item
    gets several calls); one order in 41 names a missing item."""
    ok, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        (ok * 8 + J_ITEM_UPDATE).cast("bigint").alias("seq"),
        F.concat(F.lit("user_"), _s(_m(c, 4))).alias("actor"),
        F.when(_m(ok, 41) == 0, -c).otherwise(c).cast("bigint").alias("item_id"),
        F.when(_m(ok, 7) == 0, F.concat(F.lit("Item "), _s(ok))).alias("name"),
        F.when(_m(ok, 97) == 0, "-1").when(_m(ok, 3) == 0, _s(_m(ok, 50))).alias("quantity"),
        F.when(_m(ok, 89) == 0, "2024-13-01").when(_m(ok, 5) == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("expiry_date"),
        F.when(_m(ok, 101) == 0, "2024-01-01").when(_m(ok, 103) == 0, "2023-06-01").alias("opened_date"),
        F.when(_m(ok, 113) == 0, "MEAT").when(_m(ok, 11) == 0, "CARNE").alias("category"),
        F.when(_m(ok, 13) == 0, "FREEZER").alias("location"),
        F.when(_m(ok, 4) == 1, F.concat(_s(_m(ok, 1000)), F.lit("."), F.lpad(_s(_m(c, 100)), 2, "0")))
        .alias("price"),
        F.when(_m(ok, 6) == 5, F.col("o_orderpriority")).alias("supplier"),
        F.when(_m(ok, 8) == 3, F.concat(F.lit("L"), _s(c))).alias("lot"),
    )


def insert_tasks_from_customer(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    freq = F.when(_m(k, 3) == 0, "GIORNALIERA").when(_m(k, 3) == 1, "SETTIMANALE").otherwise("MENSILE")
    return customer.select(
        k.cast("bigint").alias("seq"),
        F.concat(F.lit("user_"), _s(_m(k, 3))).alias("actor"),
        F.when(_m(k, 29) == 0, F.lit(None).cast("string")).when(_m(k, 43) == 0, F.repeat(F.lit("t"), 501))
        .otherwise(F.concat(F.lit("Call "), F.col("c_name"))).alias("title"),
        F.col("c_mktsegment").alias("description"),
        F.when(_m(k, 31) == 0, "URGENTE").when(_m(k, 3) == 0, "ALTA").when(_m(k, 3) == 1, F.lit(None))
        .otherwise("BASSA").cast("string").alias("priority"),
        F.when(_m(k, 41) == 0, "1999-02-30")
        .when(_m(k, 2) == 0, F.concat(F.lit("1999-01-"), F.lpad(_s(_m(k, 28) + 1), 2, "0"))).alias("due_date"),
        F.when(_m(k, 5) == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("user_"), _s(_m(k, 5))))
        .alias("assignee"),
        (_m(k, 4) == 0).alias("recurring"),
        F.when(_m(k, 37) == 0, F.lit(None).cast("string")).when(_m(k, 4) == 0, freq)
        .when(_m(k, 7) == 0, "MENSILE").alias("frequency"),
    )


def update_tasks_from_orders(orders: DataFrame) -> DataFrame:
    """Two update calls per order's task; the second one's priority overrides."""
    ok = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    a = orders.select(
        (ok * 8 + J_UPDATE_A).cast("bigint").alias("seq"), F.lit("user_a").alias("actor"),
        F.when(_m(ok, 43) == 0, -ok).otherwise(ok).cast("bigint").alias("task_id"),
        F.when(_m(ok, 7) == 0, F.concat(F.lit("Order "), _s(ok), F.lit(" (rev)"))).alias("title"),
        none.alias("description"),
        F.when(_m(ok, 5) == 1, "ALTA").when(_m(ok, 53) == 0, "HIGH").alias("priority"),
        F.when(_m(ok, 6) == 1, "IN_CORSO").alias("status"),
        F.when(_m(ok, 9) == 2, "1999-01-15").when(_m(ok, 59) == 0, "1999-1-32").alias("due_date"),
        none.alias("assignee"),
    )
    b = orders.select(
        (ok * 8 + J_UPDATE_B).cast("bigint").alias("seq"), F.lit("user_b").alias("actor"),
        ok.cast("bigint").alias("task_id"), none.alias("title"),
        F.when(_m(ok, 10) == 0, "checked").alias("description"),
        F.when(_m(ok, 5) == 1, "BASSA").alias("priority"),
        F.when(_m(ok, 4) == 3, "COMPLETATO").alias("status"),
        none.alias("due_date"),
        F.when(_m(ok, 3) == 0, "user_9").alias("assignee"),
    )
    return a.unionByName(b)


def complete_tasks_from_orders(orders: DataFrame) -> DataFrame:
    """Two completion calls per order's task (the second is a repeat); one order in
    41 first names a missing task instead."""
    ok = F.col("o_orderkey")
    a = orders.select(
        (ok * 8 + J_COMPLETE_A).cast("bigint").alias("seq"),
        F.concat(F.lit("user_"), _s(_m("o_custkey", 3))).alias("actor"),
        F.when(_m(ok, 41) == 0, -ok).otherwise(ok).cast("bigint").alias("task_id"),
        F.when(_m(ok, 2) == 0, "done").alias("note"),
    )
    b = orders.select(
        (ok * 8 + J_COMPLETE_B).cast("bigint").alias("seq"), F.lit("user_b").alias("actor"),
        ok.cast("bigint").alias("task_id"), F.lit(None).cast("string").alias("note"),
    )
    return a.unionByName(b)


def cancel_tasks_from_orders(orders: DataFrame) -> DataFrame:
    """Two cancel calls per order's task (repeatable); one in 43 first names a missing task."""
    ok = F.col("o_orderkey")
    a = orders.select(
        (ok * 8 + J_CANCEL_A).cast("bigint").alias("seq"), F.lit("user_c").alias("actor"),
        F.when(_m(ok, 43) == 0, -ok).otherwise(ok).cast("bigint").alias("task_id"),
        F.when(_m(ok, 2) == 1, "duplicate").alias("reason"),
    )
    b = orders.select(
        (ok * 8 + J_CANCEL_B).cast("bigint").alias("seq"), F.lit("user_d").alias("actor"),
        ok.cast("bigint").alias("task_id"), F.lit(None).cast("string").alias("reason"),
    )
    return a.unionByName(b)
