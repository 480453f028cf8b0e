"""Order-insensitive comparison of a Spark result with its DuckDB oracle."""

from __future__ import annotations

import math
from decimal import Decimal


def _norm(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{v:.9g}"
    if isinstance(v, Decimal):
        return f"{float(v):.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item())
    return str(v)


def canonical(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return cols, out


def compare(spark_df, duck_con, sql: str) -> dict:
    s_rows = [tuple(r) for r in spark_df.collect()]
    s_cols, s_vals = canonical(spark_df.columns, s_rows)
    rel = duck_con.sql(sql)
    d_cols, d_vals = canonical(rel.columns, rel.fetchall())
    res = {"spark_rows": len(s_vals), "oracle_rows": len(d_vals),
           "schema_match": s_cols == d_cols, "values_match": s_vals == d_vals}
    if not res["schema_match"]:
        res["spark_cols"], res["oracle_cols"] = s_cols, d_cols
    elif not res["values_match"]:
        a, b = set(s_vals), set(d_vals)
        res["only_spark"] = sorted(a - b)[:3]
        res["only_oracle"] = sorted(b - a)[:3]
    return res


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con
