"""Audit log: rows for accepted calls, appending them, and counts per operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X

JSON_OPTS = {"ignoreNullFields": "false"}


def payload(**fields: Column) -> Column:
    """JSON text of the given fields in the given order; nulls are written."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), JSON_OPTS)


def audit_rows(df: DataFrame, op_type: str, table_name: str, record_id: Column, details: Column,
               now) -> DataFrame:
    """One audit row per row of ``df`` (the accepted calls), keeping ``seq``."""
    return df.select(
        F.col("seq"),
        F.lit(op_type).alias("op_type"),
        F.lit(table_name).alias("table_name"),
        record_id.cast("bigint").alias("record_id"),
        details.alias("details"),
        F.coalesce(F.col("actor"), F.lit("unknown")).alias("actor"),
        X.ts_lit(now).alias("ts"),
    )


def numbered_audit(audit_log: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with their ids in the log: ``max(log_id) + seq``, where ``seq`` is the call
    order within the batch: unique, increasing, no sort or shuffle needed (gaps are
    allowed, as with a database sequence)."""
    base = audit_log.select(F.coalesce(F.max("log_id"), F.lit(0))).scalar()
    return rows.select((base + F.col("seq")).alias("log_id"), "op_type", "table_name", "record_id", "details", "actor", "ts")


def append_audit(audit_log: DataFrame, rows: DataFrame) -> DataFrame:
    """The audit log with ``rows`` appended."""
    new = numbered_audit(audit_log, rows)
    return audit_log.select(*new.columns).unionByName(new)


def ops_by_type(audit_log: DataFrame, sort: bool = True) -> DataFrame:
    """Operations per type, most frequent first."""
    out = audit_log.groupBy("op_type").agg(F.count(F.lit(1)).alias("operations"))
    return out.orderBy(F.col("operations").desc(), F.col("op_type")) if sort else out
