"""DuckDB oracle SQL for the write jobs: command frames, checks, last-non-null
merge, first-call-wins completion, respawn and audit rows, all in plain SQL."""

from __future__ import annotations

from .oracle import AUDIT, BAND, EXPIRING_3, INVENTORY, TASK, iso_date, iso_ts, with_views

INSERT_NOW = "TIMESTAMP '2024-01-15 10:00:00'"
TASK_NOW = "TIMESTAMP '1998-12-31 00:00:00'"


def W(*ctes: str) -> str:
    """``WITH`` over the given CTE texts, in order."""
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"


def strict(col: str) -> str:
    return (f"(CASE WHEN regexp_full_match({col}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') "
            f"THEN CAST(try_strptime({col}, '%Y-%m-%d') AS DATE) END)")


def num(col: str) -> str:
    return f"TRY_CAST(trim({col}) AS DECIMAL(38,10))"


INSERT_ITEM_CMD = """icmd AS (
 SELECT p_partkey AS seq, 'user_' || CAST(p_partkey % 3 AS VARCHAR) AS actor,
  CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN repeat('n', 256) ELSE p_name END AS name,
  CASE WHEN p_partkey % 17 = 0 THEN '0' WHEN p_partkey % 19 = 0 THEN '12345678.9' WHEN p_partkey % 31 = 0 THEN 'abc'
       ELSE CAST(p_size AS VARCHAR) || '.25' END AS quantity,
  CASE WHEN p_partkey % 37 = 0 THEN 'LITRO'
       ELSE CASE p_partkey % 4 WHEN 0 THEN 'PEZZI' WHEN 1 THEN 'KG' WHEN 2 THEN 'LITRI' ELSE 'GRAMMI' END END AS unit,
  CASE p_type WHEN 'ECONOMY' THEN 'LATTICINI' WHEN 'LARGE' THEN 'VERDURE' WHEN 'MEDIUM' THEN 'FRUTTA'
       WHEN 'PROMO' THEN 'CARNE' WHEN 'SMALL' THEN 'PESCE' ELSE 'CONSERVE' END AS category,
  CASE p_size % 4 WHEN 0 THEN 'FRIGO' WHEN 1 THEN 'FREEZER' WHEN 2 THEN 'DISPENSA' ELSE 'CANTINA' END AS location,
  CASE WHEN p_partkey % 41 = 0 THEN '2024-02-30' WHEN p_partkey % 43 = 0 THEN '2024-1-5'
       WHEN p_partkey % 11 = 0 THEN NULL
       ELSE strftime(DATE '2024-01-15' + CAST(p_partkey % 41 - 10 AS INTEGER), '%Y-%m-%d') END AS expiry_date,
  CASE WHEN p_partkey % 47 = 0 THEN '2024-03-01' WHEN p_partkey % 53 = 0 THEN '2024-01-10'
       WHEN p_partkey % 3 = 0 THEN '2024-01-15' END AS opened_date,
  CASE WHEN p_partkey % 59 = 0 THEN '0' WHEN p_partkey % 61 = 0 THEN '-1.00'
       ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) END AS price,
  p_brand AS supplier, CAST(NULL AS VARCHAR) AS lot
 FROM part)"""


def _insert_items_checked() -> str:
    q, p = num("quantity"), num("price")
    exp, opened = strict("expiry_date"), strict("opened_date")
    has_exp = "(expiry_date IS NOT NULL AND expiry_date <> '')"
    has_op = "(opened_date IS NOT NULL AND opened_date <> '')"
    has_p = "(price IS NOT NULL AND price <> '')"
    today = "DATE '2024-01-15'"
    return f"""chk AS (
 SELECT *, CASE
  WHEN name IS NULL OR quantity IS NULL OR unit IS NULL OR category IS NULL OR location IS NULL THEN 'MISSING_FIELD'
  WHEN unit NOT IN ('PEZZI','KG','LITRI','GRAMMI') THEN 'INVALID_UNIT'
  WHEN category NOT IN ('LATTICINI','VERDURE','FRUTTA','CARNE','PESCE','CONSERVE','BEVANDE','ALTRO') THEN 'INVALID_CATEGORY'
  WHEN location NOT IN ('FRIGO','FREEZER','DISPENSA','CANTINA') THEN 'INVALID_LOCATION'
  WHEN {q} IS NULL THEN 'INVALID_QUANTITY'
  WHEN {q} <= 0 THEN 'NON_POSITIVE_QUANTITY'
  WHEN {has_exp} AND {exp} IS NULL THEN 'INVALID_EXPIRY_DATE'
  WHEN {has_op} AND {opened} IS NULL THEN 'INVALID_OPENED_DATE'
  WHEN {has_op} AND {opened} > {today} THEN 'OPENED_IN_FUTURE'
  WHEN length(name) > 255 THEN 'NAME_TOO_LONG'
  WHEN abs(round({q}, 3)) >= 10000000 THEN 'QUANTITY_OUT_OF_RANGE'
  WHEN {has_p} AND {p} IS NULL THEN 'INVALID_PRICE'
  WHEN {has_p} AND abs(round({p}, 2)) >= 100000000 THEN 'PRICE_OUT_OF_RANGE'
  WHEN length(supplier) > 255 THEN 'SUPPLIER_TOO_LONG'
  WHEN length(lot) > 100 THEN 'LOT_TOO_LONG'
  WHEN length(actor) > 100 THEN 'ACTOR_TOO_LONG'
  WHEN {has_op} AND {opened} < {today} THEN 'OPENED_BEFORE_INSERT'
  WHEN {has_p} AND round({p}, 2) < 0 THEN 'PRICE_NEGATIVE'
 END AS code,
 (SELECT max(item_id) FROM inventory) + seq AS new_id,
 CAST(round({q}, 3) AS DECIMAL(10,3)) AS q3, round({p}, 2) AS p2,
 CASE WHEN {has_exp} THEN {exp} END AS exp_d, CASE WHEN {has_op} THEN {opened} END AS op_d,
 {has_p} AS has_p
 FROM icmd)
"""


def q_item_insert() -> str:
    return W(INVENTORY, INSERT_ITEM_CMD, _insert_items_checked()) + f"""
SELECT new_id AS item_id, name, CAST(q3 AS DOUBLE) AS quantity, unit, {iso_date('exp_d')} AS expiry_date,
  {iso_date('op_d')} AS opened_date, category, location,
  CAST(CASE WHEN has_p AND p2 <> 0 THEN p2 END AS DOUBLE) AS price, supplier, lot,
  {iso_ts(INSERT_NOW)} AS created_at, {iso_ts(INSERT_NOW)} AS updated_at, COALESCE(actor, 'unknown') AS updated_by
FROM chk WHERE code IS NULL"""


def q_item_insert_rejects() -> str:
    return W(INVENTORY, INSERT_ITEM_CMD, _insert_items_checked()) + "SELECT seq, code FROM chk WHERE code IS NOT NULL"


UPDATE_ITEM_CMD = """ucmd AS (
 SELECT o_orderkey * 8 + 0 AS seq, 'user_' || CAST(o_custkey % 4 AS VARCHAR) AS actor,
  CASE WHEN o_orderkey % 41 = 0 THEN -o_custkey ELSE o_custkey END AS item_id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Item ' || CAST(o_orderkey AS VARCHAR) END AS name,
  CASE WHEN o_orderkey % 97 = 0 THEN '-1' WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 50 AS VARCHAR) END AS quantity,
  CASE WHEN o_orderkey % 89 = 0 THEN '2024-13-01' WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y-%m-%d') END
    AS expiry_date,
  CASE WHEN o_orderkey % 101 = 0 THEN '2024-01-01' WHEN o_orderkey % 103 = 0 THEN '2023-06-01' END AS opened_date,
  CASE WHEN o_orderkey % 113 = 0 THEN 'MEAT' WHEN o_orderkey % 11 = 0 THEN 'CARNE' END AS category,
  CASE WHEN o_orderkey % 13 = 0 THEN 'FREEZER' END AS location,
  CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderkey % 1000 AS VARCHAR) || '.' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0')
    END AS price,
  CASE WHEN o_orderkey % 6 = 5 THEN o_orderpriority END AS supplier,
  CASE WHEN o_orderkey % 8 = 3 THEN 'L' || CAST(o_custkey AS VARCHAR) END AS lot
 FROM orders)"""


def _update_items_checked() -> str:
    q, p = num("c.quantity"), num("c.price")
    exp, opened = strict("c.expiry_date"), strict("c.opened_date")
    return f"""chk AS (
 SELECT c.*, CASE
  WHEN c.item_id IS NULL OR c.item_id = 0 THEN 'MISSING_ID'
  WHEN i.item_id IS NULL THEN 'NOT_FOUND'
  WHEN c.name IS NULL AND c.quantity IS NULL AND c.expiry_date IS NULL AND c.opened_date IS NULL
   AND c.category IS NULL AND c.location IS NULL AND c.price IS NULL AND c.supplier IS NULL AND c.lot IS NULL
   THEN 'NOTHING_TO_UPDATE'
  WHEN c.quantity IS NOT NULL AND {q} IS NULL THEN 'INVALID_QUANTITY'
  WHEN c.price IS NOT NULL AND {p} IS NULL THEN 'INVALID_PRICE'
  WHEN c.expiry_date IS NOT NULL AND {exp} IS NULL THEN 'INVALID_EXPIRY_DATE'
  WHEN c.opened_date IS NOT NULL AND {opened} IS NULL THEN 'INVALID_OPENED_DATE'
  WHEN length(c.name) > 255 THEN 'NAME_TOO_LONG'
  WHEN {q} IS NOT NULL AND abs(round({q}, 3)) >= 10000000 THEN 'QUANTITY_OUT_OF_RANGE'
  WHEN c.category NOT IN ('LATTICINI','VERDURE','FRUTTA','CARNE','PESCE','CONSERVE','BEVANDE','ALTRO') THEN 'INVALID_CATEGORY'
  WHEN c.location NOT IN ('FRIGO','FREEZER','DISPENSA','CANTINA') THEN 'INVALID_LOCATION'
  WHEN {p} IS NOT NULL AND abs(round({p}, 2)) >= 100000000 THEN 'PRICE_OUT_OF_RANGE'
  WHEN length(c.supplier) > 255 THEN 'SUPPLIER_TOO_LONG'
  WHEN length(c.lot) > 100 THEN 'LOT_TOO_LONG'
  WHEN length(c.actor) > 100 THEN 'ACTOR_TOO_LONG'
  WHEN round({q}, 3) < 0 THEN 'QUANTITY_NEGATIVE'
  WHEN {opened} < CAST(i.created_at AS DATE) THEN 'OPENED_BEFORE_INSERT'
  WHEN round({p}, 2) < 0 THEN 'PRICE_NEGATIVE'
 END AS code,
 CAST(round({q}, 3) AS DECIMAL(10,3)) AS q3, CAST(round({p}, 2) AS DECIMAL(10,2)) AS p2,
 {exp} AS exp_d, {opened} AS op_d, CAST({q} AS DOUBLE) AS q_dbl, CAST({p} AS DOUBLE) AS p_dbl
 FROM ucmd c LEFT JOIN inventory i ON i.item_id = c.item_id)
"""


def q_item_update() -> str:
    def lastnn(v: str) -> str:
        return f"arg_max({v}, seq) FILTER (WHERE {v} IS NOT NULL)"
    return W(INVENTORY, UPDATE_ITEM_CMD, _update_items_checked()) + f""",
chg AS (
 SELECT item_id, {lastnn('name')} AS n_name, {lastnn('q3')} AS n_q, {lastnn('exp_d')} AS n_exp,
  {lastnn('op_d')} AS n_op, {lastnn('category')} AS n_cat, {lastnn('location')} AS n_loc,
  {lastnn('p2')} AS n_price, {lastnn('supplier')} AS n_sup, {lastnn('lot')} AS n_lot,
  arg_max(actor, seq) AS n_actor
 FROM chk WHERE code IS NULL GROUP BY item_id)
SELECT i.item_id, COALESCE(n_name, i.name) AS name, CAST(COALESCE(n_q, i.quantity) AS DOUBLE) AS quantity, i.unit,
 {iso_date('COALESCE(n_exp, i.expiry_date)')} AS expiry_date, {iso_date('COALESCE(n_op, i.opened_date)')} AS opened_date,
 COALESCE(n_cat, i.category) AS category, COALESCE(n_loc, i.location) AS location,
 CAST(COALESCE(n_price, i.price) AS DOUBLE) AS price, COALESCE(n_sup, i.supplier) AS supplier,
 COALESCE(n_lot, i.lot) AS lot, {iso_ts('i.created_at')} AS created_at,
 {iso_ts(f"CASE WHEN chg.item_id IS NOT NULL THEN {INSERT_NOW} ELSE i.updated_at END")} AS updated_at,
 CASE WHEN chg.item_id IS NOT NULL THEN COALESCE(n_actor, 'unknown') ELSE i.updated_by END AS updated_by
FROM inventory i LEFT JOIN chg ON chg.item_id = i.item_id"""


def q_item_update_outcomes() -> str:
    return W(INVENTORY, UPDATE_ITEM_CMD, _update_items_checked()) + """
SELECT seq, CAST(item_id AS BIGINT) AS key, code IS NULL AS ok, COALESCE(code, 'OK') AS code FROM chk"""


INSERT_TASK_CMD = """tcmd AS (
 SELECT c_custkey AS seq, 'user_' || CAST(c_custkey % 3 AS VARCHAR) AS actor,
  CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN repeat('t', 501) ELSE 'Call ' || c_name END AS title,
  c_mktsegment AS description,
  CASE WHEN c_custkey % 31 = 0 THEN 'URGENTE' WHEN c_custkey % 3 = 0 THEN 'ALTA' WHEN c_custkey % 3 = 1 THEN NULL
       ELSE 'BASSA' END AS priority,
  CASE WHEN c_custkey % 41 = 0 THEN '1999-02-30'
       WHEN c_custkey % 2 = 0 THEN '1999-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') END AS due_date,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'user_' || CAST(c_custkey % 5 AS VARCHAR) END AS assignee,
  (c_custkey % 4 = 0) AS recurring,
  CASE WHEN c_custkey % 37 = 0 THEN NULL
       WHEN c_custkey % 4 = 0 THEN CASE c_custkey % 3 WHEN 0 THEN 'GIORNALIERA' WHEN 1 THEN 'SETTIMANALE' ELSE 'MENSILE' END
       WHEN c_custkey % 7 = 0 THEN 'MENSILE' END AS frequency
 FROM customer)"""


def _insert_tasks_checked() -> str:
    due = strict("due_date")
    return f"""chk AS (
 SELECT *, CASE
  WHEN title IS NULL OR title = '' THEN 'MISSING_TITLE'
  WHEN priority IS NOT NULL AND priority NOT IN ('ALTA','MEDIA','BASSA') THEN 'INVALID_PRIORITY'
  WHEN frequency IS NOT NULL AND frequency <> '' AND frequency NOT IN ('GIORNALIERA','SETTIMANALE','MENSILE')
   THEN 'INVALID_FREQUENCY'
  WHEN COALESCE(recurring, false) AND (frequency IS NULL OR frequency = '') THEN 'MISSING_FREQUENCY'
  WHEN due_date IS NOT NULL AND due_date <> '' AND {due} IS NULL THEN 'INVALID_DUE_DATE'
  WHEN length(title) > 500 THEN 'TITLE_TOO_LONG'
  WHEN length(assignee) > 100 THEN 'ASSIGNEE_TOO_LONG'
  WHEN length(actor) > 100 THEN 'ACTOR_TOO_LONG'
 END AS code,
 (SELECT max(task_id) FROM task) + seq AS new_id,
 CASE WHEN due_date IS NOT NULL AND due_date <> '' THEN {due} END AS due_d
 FROM tcmd)
"""


def q_task_insert() -> str:
    return W(TASK, INSERT_TASK_CMD, _insert_tasks_checked()) + f"""
SELECT new_id AS task_id, title, description, COALESCE(priority, 'MEDIA') AS priority, 'DA_FARE' AS status,
 {iso_date('due_d')} AS due_date, assignee, COALESCE(recurring, false) AS recurring,
 CASE WHEN COALESCE(recurring, false) THEN frequency END AS frequency,
 COALESCE(actor, 'unknown') AS created_by, {iso_ts(TASK_NOW)} AS created_at,
 COALESCE(actor, 'unknown') AS updated_by, {iso_ts(TASK_NOW)} AS updated_at, CAST(NULL AS BIGINT) AS parent_task_id
FROM chk WHERE code IS NULL"""


def q_task_insert_rejects() -> str:
    return W(TASK, INSERT_TASK_CMD, _insert_tasks_checked()) + "SELECT seq, code FROM chk WHERE code IS NOT NULL"


UPDATE_TASK_CMD = """ut AS (
 SELECT o_orderkey * 8 + 4 AS seq, 'user_a' AS actor,
  CASE WHEN o_orderkey % 43 = 0 THEN -o_orderkey ELSE o_orderkey END AS task_id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Order ' || CAST(o_orderkey AS VARCHAR) || ' (rev)' END AS title,
  CAST(NULL AS VARCHAR) AS description,
  CASE WHEN o_orderkey % 5 = 1 THEN 'ALTA' WHEN o_orderkey % 53 = 0 THEN 'HIGH' END AS priority,
  CASE WHEN o_orderkey % 6 = 1 THEN 'IN_CORSO' END AS status,
  CASE WHEN o_orderkey % 9 = 2 THEN '1999-01-15' WHEN o_orderkey % 59 = 0 THEN '1999-1-32' END AS due_date,
  CAST(NULL AS VARCHAR) AS assignee
 FROM orders
 UNION ALL
 SELECT o_orderkey * 8 + 5, 'user_b', o_orderkey, NULL,
  CASE WHEN o_orderkey % 10 = 0 THEN 'checked' END,
  CASE WHEN o_orderkey % 5 = 1 THEN 'BASSA' END,
  CASE WHEN o_orderkey % 4 = 3 THEN 'COMPLETATO' END, NULL,
  CASE WHEN o_orderkey % 3 = 0 THEN 'user_9' END
 FROM orders)"""


def _update_tasks_checked() -> str:
    due = strict("c.due_date")
    return f"""tchk AS (
 SELECT c.*, CASE
  WHEN c.task_id IS NULL OR c.task_id = 0 THEN 'MISSING_ID'
  WHEN t.task_id IS NULL THEN 'NOT_FOUND'
  WHEN c.title IS NULL AND c.description IS NULL AND c.priority IS NULL AND c.status IS NULL
   AND c.due_date IS NULL AND c.assignee IS NULL THEN 'NOTHING_TO_UPDATE'
  WHEN c.due_date IS NOT NULL AND {due} IS NULL THEN 'INVALID_DUE_DATE'
  WHEN length(c.title) > 500 THEN 'TITLE_TOO_LONG'
  WHEN c.priority NOT IN ('ALTA','MEDIA','BASSA') THEN 'INVALID_PRIORITY'
  WHEN c.status NOT IN ('DA_FARE','IN_CORSO','COMPLETATO','ANNULLATO') THEN 'INVALID_STATUS'
  WHEN length(c.assignee) > 100 THEN 'ASSIGNEE_TOO_LONG'
  WHEN length(c.actor) > 100 THEN 'ACTOR_TOO_LONG'
 END AS code, {due} AS due_d
 FROM ut c LEFT JOIN task t ON t.task_id = c.task_id)
"""


def q_task_update() -> str:
    def lastnn(v: str) -> str:
        return f"arg_max({v}, seq) FILTER (WHERE {v} IS NOT NULL)"
    return W(TASK, UPDATE_TASK_CMD, _update_tasks_checked()) + f""",
chg AS (
 SELECT task_id, {lastnn('title')} AS n_title, {lastnn('description')} AS n_desc, {lastnn('priority')} AS n_prio,
  {lastnn('status')} AS n_status, {lastnn('due_d')} AS n_due, {lastnn('assignee')} AS n_asg,
  arg_max(actor, seq) AS n_actor
 FROM tchk WHERE code IS NULL GROUP BY task_id)
SELECT t.task_id, COALESCE(n_title, t.title) AS title, COALESCE(n_desc, t.description) AS description,
 COALESCE(n_prio, t.priority) AS priority, COALESCE(n_status, t.status) AS status,
 {iso_date('COALESCE(n_due, t.due_date)')} AS due_date, COALESCE(n_asg, t.assignee) AS assignee, t.recurring,
 t.frequency, t.created_by, {iso_ts('t.created_at')} AS created_at,
 CASE WHEN chg.task_id IS NOT NULL THEN COALESCE(n_actor, 'unknown') ELSE t.updated_by END AS updated_by,
 {iso_ts(f"CASE WHEN chg.task_id IS NOT NULL THEN {TASK_NOW} ELSE t.updated_at END")} AS updated_at,
 t.parent_task_id
FROM task t LEFT JOIN chg ON chg.task_id = t.task_id"""


def q_task_update_outcomes() -> str:
    return W(TASK, UPDATE_TASK_CMD, _update_tasks_checked()) + """
SELECT seq, CAST(task_id AS BIGINT) AS key, code IS NULL AS ok, COALESCE(code, 'OK') AS code FROM tchk"""


COMPLETE_CMD = """cc AS (
 SELECT o_orderkey * 8 + 1 AS seq, 'user_' || CAST(o_custkey % 3 AS VARCHAR) AS actor,
  CASE WHEN o_orderkey % 41 = 0 THEN -o_orderkey ELSE o_orderkey END AS task_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'done' END AS note
 FROM orders
 UNION ALL
 SELECT o_orderkey * 8 + 2, 'user_b', o_orderkey, NULL FROM orders)"""


def _complete_checked() -> str:
    return """firsts AS (SELECT task_id, min(seq) AS first_seq FROM cc WHERE task_id IS NOT NULL GROUP BY task_id),
cchk AS (
 SELECT c.*, t.recurring AS rec, CASE
  WHEN c.task_id IS NULL OR c.task_id = 0 THEN 'MISSING_ID'
  WHEN t.task_id IS NULL THEN 'NOT_FOUND'
  WHEN t.status = 'COMPLETATO' OR c.seq <> f.first_seq THEN 'ALREADY_COMPLETED'
 END AS code
 FROM cc c LEFT JOIN task t ON t.task_id = c.task_id LEFT JOIN firsts f ON f.task_id = c.task_id),
acc AS (SELECT *, CASE WHEN rec THEN (SELECT max(task_id) FROM task) + seq END AS new_id FROM cchk WHERE code IS NULL)
"""


def q_task_complete() -> str:
    return W(TASK, COMPLETE_CMD, _complete_checked()) + """
SELECT seq, CAST(task_id AS BIGINT) AS key, code IS NULL AS ok, COALESCE(code, 'OK') AS code FROM cchk"""


_RESPAWN = f"""SELECT a.new_id AS task_id, t.title, t.description, t.priority, 'DA_FARE' AS status,
 {iso_date("CAST(t.due_date + CAST(CASE t.frequency WHEN 'GIORNALIERA' THEN 1 WHEN 'SETTIMANALE' THEN 7 WHEN 'MENSILE' THEN 30 END AS INTEGER) AS DATE)")} AS due_date,
 t.assignee, true AS recurring, t.frequency, COALESCE(a.actor, 'unknown') AS created_by,
 {iso_ts(TASK_NOW)} AS created_at, COALESCE(a.actor, 'unknown') AS updated_by, {iso_ts(TASK_NOW)} AS updated_at,
 CAST(t.task_id AS BIGINT) AS parent_task_id
FROM acc a JOIN task t ON t.task_id = a.task_id WHERE a.rec"""


def q_task_respawn() -> str:
    return W(TASK, COMPLETE_CMD, _complete_checked()) + _RESPAWN


def q_task_complete_table() -> str:
    return W(TASK, COMPLETE_CMD, _complete_checked()) + f"""
SELECT t.task_id, t.title, t.description, t.priority,
 CASE WHEN a.task_id IS NOT NULL THEN 'COMPLETATO' ELSE t.status END AS status, {iso_date('t.due_date')} AS due_date,
 t.assignee, t.recurring, t.frequency, t.created_by, {iso_ts('t.created_at')} AS created_at,
 CASE WHEN a.task_id IS NOT NULL THEN COALESCE(a.actor, 'unknown') ELSE t.updated_by END AS updated_by,
 {iso_ts(f"CASE WHEN a.task_id IS NOT NULL THEN {TASK_NOW} ELSE t.updated_at END")} AS updated_at, t.parent_task_id
FROM task t LEFT JOIN acc a ON a.task_id = t.task_id
UNION ALL
""" + _RESPAWN


CANCEL_CMD = """xc AS (
 SELECT o_orderkey * 8 + 3 AS seq, 'user_c' AS actor,
  CASE WHEN o_orderkey % 43 = 0 THEN -o_orderkey ELSE o_orderkey END AS task_id,
  CASE WHEN o_orderkey % 2 = 1 THEN 'duplicate' END AS reason
 FROM orders
 UNION ALL
 SELECT o_orderkey * 8 + 6, 'user_d', o_orderkey, NULL FROM orders)"""


def _cancel_checked() -> str:
    return """xchk AS (
 SELECT c.*, CASE WHEN c.task_id IS NULL OR c.task_id = 0 THEN 'MISSING_ID'
   WHEN t.task_id IS NULL THEN 'NOT_FOUND' END AS code
 FROM xc c LEFT JOIN task t ON t.task_id = c.task_id)
"""


def q_task_cancel() -> str:
    return W(TASK, CANCEL_CMD, _cancel_checked()) + f""",
chg AS (SELECT task_id, arg_max(actor, seq) AS n_actor FROM xchk WHERE code IS NULL GROUP BY task_id)
SELECT t.task_id, CASE WHEN chg.task_id IS NOT NULL THEN 'ANNULLATO' ELSE t.status END AS status,
 CASE WHEN chg.task_id IS NOT NULL THEN COALESCE(n_actor, 'unknown') ELSE t.updated_by END AS updated_by,
 {iso_ts(f"CASE WHEN chg.task_id IS NOT NULL THEN {TASK_NOW} ELSE t.updated_at END")} AS updated_at
FROM task t LEFT JOIN chg ON chg.task_id = t.task_id"""


def q_task_cancel_outcomes() -> str:
    return W(TASK, CANCEL_CMD, _cancel_checked()) + """
SELECT seq, CAST(task_id AS BIGINT) AS key, code IS NULL AS ok, COALESCE(code, 'OK') AS code FROM xchk"""


def _json_nonnull(pairs: list[tuple[str, str]]) -> str:
    """JSON object text of the non-null pairs, in order (Spark's default to_json)."""
    parts = ", ".join(f"CASE WHEN {v} IS NOT NULL THEN '\"{k}\":' || CAST(to_json({v}) AS VARCHAR) END"
                      for k, v in pairs)
    return f"('{{' || concat_ws(',', {parts}) || '}}')"


def q_audit_append() -> str:
    item_det = _json_nonnull([("nome", "name"), ("quantita", "q_dbl"), ("data_scadenza", "expiry_date"),
                              ("data_apertura", "opened_date"), ("categoria", "category"),
                              ("ubicazione", "location"), ("prezzo_acquisto", "p_dbl"),
                              ("fornitore", "supplier"), ("lotto_acquisto", "lot")])
    task_det = _json_nonnull([("titolo", "title"), ("descrizione", "description"), ("priorita", "priority"),
                              ("stato", "status"), ("data_scadenza", "due_date"), ("assegnatario", "assignee")])
    body = W(AUDIT, INVENTORY, TASK, UPDATE_ITEM_CMD, UPDATE_TASK_CMD, COMPLETE_CMD, CANCEL_CMD,
             _update_items_checked(), _update_tasks_checked(), _complete_checked(), _cancel_checked())
    ts = iso_ts("ts")
    return body + f""",
base AS (SELECT max(log_id) AS m FROM audit_log),
newrows AS (
 SELECT seq, 'AGGIORNAMENTO_ALIMENTO' AS op_type, 'alimenti' AS table_name, item_id AS record_id,
  {item_det} AS details, COALESCE(actor, 'unknown') AS actor, {INSERT_NOW} AS ts FROM chk WHERE code IS NULL
 UNION ALL
 SELECT seq, 'AGGIORNAMENTO_TASK', 'task', task_id, {task_det}, COALESCE(actor, 'unknown'), {TASK_NOW}
 FROM tchk WHERE code IS NULL
 UNION ALL
 SELECT seq, 'COMPLETAMENTO_TASK', 'task', task_id,
  json_object('note_completamento', note, 'ricorrente', rec, 'nuovo_task_id', new_id)::VARCHAR,
  COALESCE(actor, 'unknown'), {TASK_NOW} FROM acc
 UNION ALL
 SELECT seq, 'CANCELLAZIONE_TASK', 'task', task_id, json_object('motivo', reason)::VARCHAR,
  COALESCE(actor, 'unknown'), {TASK_NOW} FROM xchk WHERE code IS NULL)
SELECT log_id, op_type, table_name, record_id, details, actor, {ts} AS ts FROM audit_log
UNION ALL
SELECT (SELECT m FROM base) + seq, op_type, table_name, CAST(record_id AS BIGINT), details, actor, {ts} FROM newrows"""


STOCK_JSON_FIELDS = [("id", "item_id"), ("nome", "name"), ("quantita", "CAST(quantity AS DOUBLE)"),
                     ("unita_misura", "unit"), ("categoria", "category"), ("ubicazione", "location"),
                     ("data_scadenza", iso_date("expiry_date")),
                     ("giorni_alla_scadenza", "datediff('day', DATE '2024-01-15', expiry_date)"),
                     ("prezzo_acquisto", "CAST(CASE WHEN price <> 0 THEN price END AS DOUBLE)"),
                     ("fornitore", "supplier"), ("data_inserimento", iso_ts("created_at")),
                     ("ultima_modifica", iso_ts("updated_at"))]


def q_stock_list_json() -> str:
    args = ", ".join(f"'{k}', {v}" for k, v in STOCK_JSON_FIELDS)
    alert = ("CASE WHEN datediff('day', DATE '2024-01-15', expiry_date) < 0 THEN 'SCADUTO' "
             "WHEN datediff('day', DATE '2024-01-15', expiry_date) <= 3 THEN 'IN_SCADENZA' END")
    return with_views(INVENTORY) + f"""
SELECT item_id, CASE WHEN {alert} IS NULL THEN json_object({args})::VARCHAR
  ELSE json_object({args}, 'alert', {alert})::VARCHAR END AS json
FROM inventory WHERE quantity > 0"""


def q_task_list_json() -> str:
    days = "datediff('day', DATE '1998-12-31', due_date)"
    fields = [("id", "task_id"), ("titolo", "title"), ("descrizione", "description"), ("priorita", "priority"), ("stato", "status"),
              ("data_scadenza", iso_date("due_date")), ("giorni_alla_scadenza", days), ("assegnatario", "assignee"),
              ("task_ricorrente", "recurring"), ("frequenza_ricorrenza", "frequency"), ("creato_da", "created_by"),
              ("data_creazione", iso_ts("created_at")), ("ultima_modifica", iso_ts("updated_at"))]
    args = ", ".join(f"'{k}', {v}" for k, v in fields)
    alert = f"CASE WHEN {days} < 0 THEN 'SCADUTO' WHEN {days} <= 1 THEN 'SCADENZA_IMMINENTE' END"
    return with_views(TASK) + f"""
SELECT task_id, CASE WHEN {alert} IS NULL THEN json_object({args})::VARCHAR
  ELSE json_object({args}, 'alert', {alert})::VARCHAR END AS json FROM task"""


def q_expiring_json() -> str:
    fields = [("id", "item_id"), ("nome", "name"), ("quantita", "CAST(quantity AS DOUBLE)"), ("unita_misura", "unit"),
              ("data_scadenza", iso_date("expiry_date")), ("giorni_alla_scadenza", "datediff('day', DATE '2024-01-15', expiry_date)"),
              ("categoria", "category"), ("ubicazione", "location"), ("priorita", BAND)]
    args = ", ".join(f"'{k}', {v}" for k, v in fields)
    return with_views(INVENTORY) + f"""
SELECT item_id, json_object({args})::VARCHAR AS json FROM inventory WHERE {EXPIRING_3}"""


def q_audit_inserts() -> str:
    items = W(INVENTORY, INSERT_ITEM_CMD, _insert_items_checked()) + f"""
SELECT seq * 2 AS n, 'INSERIMENTO_ALIMENTO' AS op_type, 'alimenti' AS table_name, new_id AS record_id,
 json_object('nome', name, 'quantita', CAST(q3 AS DOUBLE), 'categoria', category, 'ubicazione', location)::VARCHAR AS details,
 COALESCE(actor, 'unknown') AS actor, {iso_ts(INSERT_NOW)} AS ts FROM chk WHERE code IS NULL"""
    tasks = W(TASK, INSERT_TASK_CMD, _insert_tasks_checked()) + f"""
SELECT seq * 2 + 1 AS n, 'INSERIMENTO_TASK' AS op_type, 'task' AS table_name, new_id AS record_id,
 json_object('titolo', title, 'priorita', COALESCE(priority, 'MEDIA'))::VARCHAR AS details,
 COALESCE(actor, 'unknown') AS actor, {iso_ts(TASK_NOW)} AS ts FROM chk WHERE code IS NULL"""
    return f"""SELECT (SELECT max(event_id) FROM events) + n AS log_id, * EXCLUDE n
FROM (SELECT * FROM ({items}) UNION ALL SELECT * FROM ({tasks}))"""


def q_item_insert_applied() -> str:
    """The whole stock after the insert job."""
    return f"""SELECT * FROM ({q_item_insert()}) UNION ALL SELECT * FROM ({W(INVENTORY)}
SELECT item_id, name, CAST(quantity AS DOUBLE) AS quantity, unit, {iso_date('expiry_date')} AS expiry_date,
  {iso_date('opened_date')} AS opened_date, category, location, CAST(price AS DOUBLE) AS price, supplier, lot,
  {iso_ts('created_at')} AS created_at, {iso_ts('updated_at')} AS updated_at, updated_by FROM inventory)"""
