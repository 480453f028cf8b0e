"""Unclean views of the canonical tables and calls: every row of the driver tables kept,
with faults planted by key, so that every rule and every refusal has rows to find. Ids
that must not exist are negative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def _every(col: str, k: int) -> Column:
    return F.pmod(F.col(col), F.lit(k)) == 0


def _spoilt(df: DataFrame, faults: dict[str, list[tuple[Column, object]]]) -> DataFrame:
    """``df`` with the first fault of a column that applies put in its place."""
    out = []
    for f in df.schema.fields:
        col = F.col(f.name)
        for when, value in reversed(faults.get(f.name, [])):
            col = F.when(when, value if isinstance(value, Column) else F.lit(value)).otherwise(col)
        out.append(col.cast(f.dataType).alias(f.name))
    return df.select(*out)


def inventory(clean: DataFrame) -> DataFrame:
    every = lambda k: _every("item_id", k)
    return _spoilt(clean, {
        "name": [(every(17), None), (every(19), F.repeat(F.lit("n"), S.MAX_LEN["name"] + 1))],
        "quantity": [(every(23), -1)], "unit": [(every(29), "LITRO")], "category": [(every(31), "MEAT")],
        "location": [(every(37), "ATTIC")], "price": [(every(41), -1)],
        "supplier": [(every(43), F.repeat(F.lit("s"), S.MAX_LEN["supplier"] + 1))],
        "lot": [(every(47), F.repeat(F.lit("l"), S.MAX_LEN["lot"] + 1))], "updated_by": [(every(53), None)]})


def tasks(clean: DataFrame) -> DataFrame:
    every = lambda k: _every("task_id", k)
    return _spoilt(clean, {
        "title": [(every(17), None), (every(19), F.repeat(F.lit("t"), S.MAX_LEN["title"] + 1))],
        "priority": [(every(23), "HIGH")], "status": [(every(29), "OPEN")],
        "frequency": [(every(31), "ANNUALE"), (every(37), "MENSILE"), (every(41), None)],
        "recurring": [(every(37), False), (every(41), True)],
        "assignee": [(every(43), F.repeat(F.lit("a"), S.MAX_LEN["assignee"] + 1))], "created_by": [(every(47), None)],
        "parent_task_id": [(every(7), -F.col("task_id")), (every(11), F.col("task_id"))]})


def consumption(clean: DataFrame) -> DataFrame:
    """One fact in thirteen (by its id) points at an item that does not exist."""
    return _spoilt(clean, {"item_id": [(_every("consumption_id", 13), -F.col("item_id"))]})


def consume_calls(calls: DataFrame) -> DataFrame:
    """Lineitem consume calls with unknown, missing and null items, quantities of zero and
    below, and a reason that no call may give."""
    every = lambda k: _every("l_orderkey", k)
    return _spoilt(calls, {
        "item_id": [(every(13), -F.col("item_id")), (every(17), 0), (every(19), None)],
        "qty": [(every(11), 0), (every(23), -F.col("qty"))], "reason": [(every(7), "PERSO")]})
