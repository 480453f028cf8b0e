"""DuckDB oracle for the ledger: a recursive CTE that walks each item's requests
one by one in ledger order (row number per item), carrying the balance."""

from __future__ import annotations

from .oracle import INVENTORY, UNCLEAN_INVENTORY, iso_ts

REASON = "CASE l_returnflag WHEN 'A' THEN 'CONSUMATO' WHEN 'N' THEN 'SCADUTO' ELSE 'BUTTATO' END"
CALLS = f"""calls AS (
 SELECT l_partkey AS item_id, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate,
  CAST(l_quantity AS DECIMAL(10,3)) AS qty, {{force}} AS force, {REASON} AS reason FROM lineitem)"""
# faults planted in the calls
UNCLEAN_CALLS = """calls AS (SELECT * REPLACE (
  CASE WHEN l_orderkey % 13 = 0 THEN -item_id WHEN l_orderkey % 17 = 0 THEN 0 WHEN l_orderkey % 19 = 0 THEN NULL ELSE item_id END AS item_id,
  CAST(CASE WHEN l_orderkey % 11 = 0 THEN 0 WHEN l_orderkey % 23 = 0 THEN -qty ELSE qty END AS DECIMAL(10,3)) AS qty,
  CASE WHEN l_orderkey % 7 = 0 THEN 'PERSO' ELSE reason END AS reason) FROM clean_calls)"""
ORDER = "l_shipdate, l_orderkey, l_linenumber, l_suppkey, qty, l_extendedprice, reason"
CMD = CALLS + f""",
cmd AS (SELECT *, CAST(qty * 1000 AS BIGINT) AS q, row_number() OVER (PARTITION BY item_id ORDER BY {ORDER}) AS rn FROM calls)"""

PRE = """CASE WHEN c.item_id IS NULL OR c.item_id = 0 OR c.q = 0 THEN 'MISSING_FIELD'
  WHEN c.q < 0 THEN 'NON_POSITIVE_QUANTITY' END"""
REASONS = "('CONSUMATO', 'SCADUTO', 'BUTTATO')"


def _walk(force: str, pre: str = PRE, cmd: str = CMD, stock: str = INVENTORY, table: str = "inventory") -> str:
    """Every call with its balances and code. ``pre``: SQL code of a refusal decided
    before the balance test. Stock below zero counts as zero; an item without stock rows
    has no balance, and its calls are refused."""
    accepted = f"({pre}) IS NULL AND (c.q <= w.bal OR c.force) AND c.reason IN {REASONS}"
    return "WITH RECURSIVE " + stock + ",\n" + cmd.format(force=force) + f""",
opening AS (SELECT item_id, greatest(CAST(quantity * 1000 AS BIGINT), 0) AS b FROM {table}),
steps AS (
 SELECT o.item_id, CAST(0 AS BIGINT) AS rn, o.b AS bal, CAST(NULL AS BIGINT) AS bal_before,
        CAST(NULL AS BOOLEAN) AS ok, CAST(NULL AS VARCHAR) AS code
 FROM opening o WHERE o.item_id IN (SELECT item_id FROM cmd)
 UNION ALL
 SELECT c.item_id, c.rn,
  CASE WHEN {accepted} THEN greatest(0, w.bal - c.q) ELSE w.bal END,
  w.bal, {accepted},
  CASE WHEN ({pre}) IS NOT NULL THEN {pre}
       WHEN c.q > w.bal AND NOT c.force THEN 'INSUFFICIENT'
       WHEN c.reason NOT IN {REASONS} THEN 'INVALID_REASON'
       WHEN greatest(0, w.bal - c.q) = 0 THEN 'EXHAUSTED' ELSE 'OK' END
 FROM steps w JOIN cmd c ON c.item_id = w.item_id AND c.rn = w.rn + 1),
walk AS (
 SELECT c.*, s.bal, s.bal_before, coalesce(s.ok, false) AS ok, coalesce(s.code, ({pre}), 'NOT_FOUND') AS code
 FROM cmd c LEFT JOIN steps s ON s.item_id = c.item_id AND s.rn = c.rn)
"""


def _outcomes_select() -> str:
    return """
SELECT item_id, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey,
 CAST(qty AS DOUBLE) AS qty, force AS forced, ok, code,
 CAST(bal_before AS DOUBLE) / 1000.0 AS balance_before, CAST(bal AS DOUBLE) / 1000.0 AS balance_after
FROM walk"""


def q_consume_outcomes() -> str:
    return _walk("(l_orderkey % 10 = 0)") + _outcomes_select()


def q_consume_ledger() -> str:
    return _walk("(l_orderkey % 10 = 0)") + """
SELECT item_id, CAST(max(bal_before) AS DOUBLE) / 1000.0 AS opening, CAST(min(bal) AS DOUBLE) / 1000.0 AS closing,
 CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS rejected
FROM walk GROUP BY item_id"""


def q_consume_stock_table() -> str:
    return _walk("(l_orderkey % 10 = 0)") + """,
last_ok AS (
 SELECT item_id, min(bal) AS closing, arg_max('user_' || CAST(l_suppkey % 5 AS VARCHAR), rn) AS actor
 FROM walk WHERE ok GROUP BY item_id)
SELECT i.item_id, CAST(COALESCE(CAST(k.closing AS DECIMAL(20,3)) / 1000, i.quantity) AS DOUBLE) AS quantity,
 CASE WHEN k.item_id IS NOT NULL THEN k.actor ELSE i.updated_by END AS updated_by,
 CASE WHEN k.item_id IS NOT NULL THEN '1998-12-31T00:00:00' ELSE '2024-01-01T00:00:00' END AS updated_at
FROM inventory i LEFT JOIN last_ok k ON k.item_id = i.item_id"""


def q_consume_forced() -> str:
    return _walk("true") + _outcomes_select()


def q_discard_ledger() -> str:
    return _walk("false", "CASE WHEN c.item_id = 0 THEN 'MISSING_FIELD' "
                 "WHEN c.reason NOT IN ('SCADUTO', 'BUTTATO') THEN 'INVALID_REASON' END") + _outcomes_select()


def q_consume_unclean() -> str:
    unclean = CMD.replace("calls AS (\n", "clean_calls AS (\n", 1).replace("\ncmd AS", "\n" + UNCLEAN_CALLS + ",\ncmd AS", 1)
    return _walk("(l_orderkey % 10 = 0)", cmd=unclean, stock=INVENTORY + ",\n" + UNCLEAN_INVENTORY,
                 table="unclean_inventory") + _outcomes_select()


# calls numbered in their order over all items
NUMBERED = f""",
ranked AS (SELECT *, row_number() OVER (ORDER BY {ORDER}, item_id) AS seq FROM walk),
added AS (SELECT * FROM ranked WHERE ok)
"""


def q_consume_facts() -> str:
    return _walk("(l_orderkey % 10 = 0)") + NUMBERED + f"""
SELECT (SELECT max(l_orderkey * 16 + l_linenumber) FROM lineitem) + seq AS consumption_id, item_id,
 CAST(qty AS DOUBLE) AS qty, {iso_ts("l_shipdate")} AS consumed_at, reason, CAST(NULL AS VARCHAR) AS note FROM added"""


def _dense(sql: str) -> str:
    """The same rows with ids that have no gaps: the rank among the accepted calls."""
    return sql.replace("added AS (SELECT * FROM ranked WHERE ok)", "added AS (SELECT * REPLACE (row_number() OVER (ORDER BY seq) AS seq) FROM ranked WHERE ok)")


def q_stream_facts() -> str:
    return _dense(q_consume_facts())


def q_stream_consume_audit() -> str:
    return _dense(q_consume_audit())


def q_consume_audit() -> str:
    k = lambda c: f"CAST({c} AS DOUBLE) / 1000.0"
    return _walk("(l_orderkey % 10 = 0)") + NUMBERED + f"""
SELECT (SELECT max(event_id) FROM events) + seq AS log_id, 'SCARICO_ALIMENTO' AS op_type, 'alimenti' AS table_name,
 item_id AS record_id, json_object('quantita_prima', {k("bal_before")}, 'quantita_consumata', {k("q")},
  'quantita_dopo', {k("bal")}, 'motivo', reason, 'forzato', force)::VARCHAR AS details,
 'user_' || CAST(l_suppkey % 5 AS VARCHAR) AS actor, '1998-12-31T00:00:00' AS ts FROM added"""
