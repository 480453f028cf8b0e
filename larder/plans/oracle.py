"""Independent DuckDB SQL for each registered query, over the driver's raw tables.

The canonical views are rebuilt here as CTEs in plain SQL (not generated from the
Spark code), so the Spark plan and the oracle share only the written rules.
Every computed column is cast on both sides to the same type: bigint, double,
boolean or text; dates and timestamps are ISO text, as the response edge prints
them.
"""

from __future__ import annotations

AS_OF = "DATE '2024-01-15'"

INVENTORY = """inventory AS (
 SELECT p_partkey AS item_id, p_name AS name,
  CAST(CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE p_size END AS DECIMAL(10,3)) AS quantity,
  CASE p_partkey % 4 WHEN 0 THEN 'PEZZI' WHEN 1 THEN 'KG' WHEN 2 THEN 'LITRI' ELSE 'GRAMMI' END AS unit,
  CASE WHEN p_partkey % 11 = 0 THEN NULL
       ELSE CAST(DATE '2024-01-15' + CAST(p_partkey % 41 - 10 AS INTEGER) AS DATE) END AS expiry_date,
  CAST(DATE '2023-12-30' + CAST(p_partkey % 5 AS INTEGER) AS DATE) AS opened_date,
  CASE p_type WHEN 'ECONOMY' THEN 'LATTICINI' WHEN 'LARGE' THEN 'VERDURE' WHEN 'MEDIUM' THEN 'FRUTTA'
       WHEN 'PROMO' THEN 'CARNE' WHEN 'SMALL' THEN 'PESCE' ELSE 'CONSERVE' END AS category,
  CASE p_size % 4 WHEN 0 THEN 'FRIGO' WHEN 1 THEN 'FREEZER' WHEN 2 THEN 'DISPENSA' ELSE 'CANTINA' END AS location,
  CAST(p_retailprice AS DECIMAL(10,2)) AS price,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS supplier,
  CAST(NULL AS VARCHAR) AS lot,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at,
  TIMESTAMP '2024-01-01 00:00:00' AS updated_at,
  'system' AS updated_by
 FROM part)"""

CONSUMPTION = """consumption AS (
 SELECT l_orderkey * 16 + l_linenumber AS consumption_id, l_partkey AS item_id,
  CAST(l_quantity AS DECIMAL(10,3)) AS qty, l_shipdate AS consumed_at,
  CASE l_returnflag WHEN 'A' THEN 'CONSUMATO' WHEN 'N' THEN 'SCADUTO' ELSE 'BUTTATO' END AS reason,
  CAST(NULL AS VARCHAR) AS note
 FROM lineitem)"""

TASK = """task AS (
 SELECT o_orderkey AS task_id, concat('Order ', CAST(o_orderkey AS VARCHAR)) AS title,
  CAST(NULL AS VARCHAR) AS description,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'ALTA'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'MEDIA' ELSE 'BASSA' END AS priority,
  CASE WHEN o_orderkey % 17 = 0 THEN 'ANNULLATO' WHEN o_orderstatus = 'O' THEN 'DA_FARE'
       WHEN o_orderstatus = 'P' THEN 'IN_CORSO' ELSE 'COMPLETATO' END AS status,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL
       ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS DATE) END AS due_date,
  CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 1 THEN 'NON_ASSEGNATO'
       ELSE concat('user_', CAST(o_custkey % 5 AS VARCHAR)) END AS assignee,
  (o_orderkey % 5 = 0) AS recurring,
  CASE WHEN o_orderkey % 5 <> 0 THEN NULL WHEN o_orderkey % 15 = 0 THEN 'GIORNALIERA'
       WHEN o_orderkey % 15 = 5 THEN 'SETTIMANALE' ELSE 'MENSILE' END AS frequency,
  'system' AS created_by, o_orderdate AS created_at, 'system' AS updated_by,
  o_orderdate AS updated_at, CAST(NULL AS BIGINT) AS parent_task_id
 FROM orders)"""

AUDIT = """audit_log AS (
 SELECT event_id AS log_id, event_type AS op_type, 'events' AS table_name, event_id AS record_id,
  props AS details, CAST(user_id AS VARCHAR) AS actor, ts
 FROM events)"""


def iso_ts(col: str, sep: str = "T") -> str:
    """Python ``isoformat`` text of a timestamp."""
    return (f"CASE WHEN {col} IS NULL THEN NULL WHEN microsecond({col}) % 1000000 = 0 "
            f"THEN strftime({col}, '%Y-%m-%d{sep}%H:%M:%S') "
            f"ELSE strftime({col}, '%Y-%m-%d{sep}%H:%M:%S.%f') END")


def iso_date(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def q_expiring_items(days: int = 3) -> str:
    return with_views(INVENTORY) + f"""
SELECT item_id, name, CAST(quantity AS DOUBLE) AS quantity, unit, {iso_date('expiry_date')} AS expiry_date,
  CAST(datediff('day', {AS_OF}, expiry_date) AS BIGINT) AS days_left, category, location
FROM inventory
WHERE expiry_date IS NOT NULL AND expiry_date <= {AS_OF} + INTERVAL {int(days)} DAY AND quantity > 0
ORDER BY expiry_date, item_id"""


def q_stock_list(where: str = "", limit: int | None = 50, cols: str | None = None) -> str:
    cols = cols or f"""item_id, name, CAST(quantity AS DOUBLE) AS quantity, unit, category, location,
  {iso_date('expiry_date')} AS expiry_date, CAST(datediff('day', {AS_OF}, expiry_date) AS BIGINT) AS days_left,
  CAST(CASE WHEN price <> 0 THEN price END AS DOUBLE) AS price, supplier,
  {iso_ts('created_at')} AS created_at, {iso_ts('updated_at')} AS updated_at, alert"""
    lim = f"LIMIT {limit}" if limit is not None else ""
    return with_views(INVENTORY) + f"""
SELECT {cols} FROM (
 SELECT *, CASE WHEN datediff('day', {AS_OF}, expiry_date) < 0 THEN 'SCADUTO'
                WHEN datediff('day', {AS_OF}, expiry_date) <= 3 THEN 'IN_SCADENZA' END AS alert
 FROM inventory WHERE quantity > 0 {where}
 ORDER BY expiry_date ASC NULLS LAST, name ASC, item_id ASC {lim})"""


def q_stock_kpis() -> str:
    return with_views(INVENTORY) + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_products,
 CAST(SUM(CASE WHEN expiry_date IS NOT NULL AND expiry_date <= {AS_OF} THEN 1 ELSE 0 END) AS BIGINT) AS expired,
 CAST(SUM(CASE WHEN expiry_date IS NOT NULL AND expiry_date <= {AS_OF} + INTERVAL 3 DAY
               AND expiry_date > {AS_OF} THEN 1 ELSE 0 END) AS BIGINT) AS expiring_3_days,
 CAST(COUNT(DISTINCT category) AS BIGINT) AS distinct_categories,
 CAST(COUNT(DISTINCT location) AS BIGINT) AS distinct_locations
FROM inventory WHERE quantity > 0"""


def q_expiring_filtered() -> str:
    return with_views(INVENTORY) + f"""
SELECT item_id, name, CAST(quantity AS DOUBLE) AS quantity, unit, {iso_date('expiry_date')} AS expiry_date,
  CAST(datediff('day', {AS_OF}, expiry_date) AS BIGINT) AS days_left, category, location
FROM inventory
WHERE expiry_date IS NOT NULL AND expiry_date <= {AS_OF} + INTERVAL 7 DAY AND quantity > 0
  AND category = 'LATTICINI' AND location = 'FRIGO'"""


BAND = f"""CASE WHEN datediff('day', {AS_OF}, expiry_date) < 0 THEN 'CRITICA_SCADUTO'
  WHEN datediff('day', {AS_OF}, expiry_date) = 0 THEN 'ALTA_SCADE_OGGI'
  WHEN datediff('day', {AS_OF}, expiry_date) <= 1 THEN 'ALTA_SCADE_DOMANI' ELSE 'MEDIA' END"""

EXPIRING_3 = f"expiry_date IS NOT NULL AND expiry_date <= {AS_OF} + INTERVAL 3 DAY AND quantity > 0"


def q_expiring_bands() -> str:
    return with_views(INVENTORY) + f"""
SELECT item_id, CAST(datediff('day', {AS_OF}, expiry_date) AS BIGINT) AS days_left, {BAND} AS band
FROM inventory WHERE {EXPIRING_3}"""


def q_expiring_band_counts() -> str:
    return with_views(INVENTORY) + f"""
SELECT {BAND} AS band, CAST(COUNT(*) AS BIGINT) AS items FROM inventory WHERE {EXPIRING_3} GROUP BY 1"""


def q_items_per_category() -> str:
    return with_views(INVENTORY) + """
SELECT category, CAST(COUNT(*) AS BIGINT) AS items FROM inventory GROUP BY category"""


def q_item_search(text: str) -> str:
    pat = "%" + text.replace("'", "''") + "%"
    return with_views(INVENTORY) + f"""
SELECT search_id, title, category, location FROM (
 SELECT 'alimento-' || CAST(item_id AS VARCHAR) AS search_id,
   name || ' (' || CAST(quantity AS VARCHAR) || ' ' || unit || ')' AS title, category, location, name, item_id
 FROM inventory
 WHERE lower(name) LIKE lower('{pat}') OR lower(category) LIKE lower('{pat}') OR lower(location) LIKE lower('{pat}')
 ORDER BY name, item_id LIMIT 10)"""


def q_item_fetch() -> str:
    return with_views(INVENTORY) + f""",
req AS (
 SELECT CASE WHEN l_linenumber = 6 THEN 'item-' || CAST(l_partkey AS VARCHAR)
             WHEN l_linenumber = 7 THEN 'alimento-' || CAST(-l_partkey AS VARCHAR)
             ELSE 'alimento-' || CAST(l_partkey AS VARCHAR) END AS request_id
 FROM lineitem),
parsed AS (
 SELECT request_id, CASE WHEN starts_with(request_id, 'alimento-')
   THEN TRY_CAST(trim(replace(request_id, 'alimento-', '')) AS BIGINT) END AS k FROM req)
SELECT request_id, i.item_id IS NOT NULL AS found, i.name,
  CAST(i.quantity AS VARCHAR) || ' ' || i.unit AS quantity, i.category, i.location,
  {iso_date('i.expiry_date')} AS expiry_date, {iso_ts('i.created_at', ' ')} AS created,
  {iso_ts('i.updated_at', ' ')} AS modified
FROM parsed p LEFT JOIN inventory i ON i.item_id = p.k"""


CONS_PERIOD = "CAST(consumed_at AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"
CONS_DAYS = 1096


def _cons_stats(group_expr: str, source: str, group_by: str) -> str:
    d = CONS_DAYS
    return f"""
SELECT group_name, CAST(COALESCE(total_qty, 0) AS DOUBLE) AS total_qty, CAST(operations AS BIGINT) AS operations,
  CAST(COALESCE((2 * CAST(total_qty * 1000 AS HUGEINT) + {d}) // (2 * {d}), 0) AS DOUBLE) / 1000.0 AS daily_mean
FROM (SELECT {group_expr} AS group_name, SUM(qty) AS total_qty, COUNT(*) AS operations
      FROM {source} WHERE {CONS_PERIOD} {group_by})"""


def q_consumption(kind: str) -> str:
    if kind == "category":
        return with_views(INVENTORY, CONSUMPTION) + _cons_stats(
            "i.category", "consumption c JOIN inventory i ON c.item_id = i.item_id", "GROUP BY i.category")
    if kind == "reason":
        return with_views(CONSUMPTION) + _cons_stats("reason", "consumption", "GROUP BY reason")
    return with_views(CONSUMPTION) + _cons_stats("'TOTALE'", "consumption", "")


def q_consumption_rollup() -> str:
    return with_views(INVENTORY, CONSUMPTION) + f"""
, g AS (SELECT i.category AS group_name, SUM(qty) AS total_qty, COUNT(*) AS operations
        FROM consumption c JOIN inventory i ON c.item_id = i.item_id WHERE {CONS_PERIOD} GROUP BY i.category)
SELECT group_name, CAST(total_qty AS DOUBLE) AS total_qty, CAST(operations AS BIGINT) AS operations, false AS is_total FROM g
UNION ALL
SELECT NULL, CAST(COALESCE(SUM(total_qty), 0) AS DOUBLE), CAST(COALESCE(SUM(operations), 0) AS BIGINT), true FROM g"""


TASK_AS_OF = "DATE '1998-12-31'"


def q_task_list(where: str = "", limit: int | None = 50, cols: str | None = None) -> str:
    days = f"datediff('day', {TASK_AS_OF}, due_date)"
    cols = cols or f"""task_id, title, description, priority, status, {iso_date('due_date')} AS due_date,
  CAST(days_left AS BIGINT) AS days_left, assignee, recurring, frequency, created_by,
  {iso_ts('created_at')} AS created_at, {iso_ts('updated_at')} AS updated_at, alert"""
    lim = f"LIMIT {limit}" if limit is not None else ""
    return with_views(TASK) + f"""
SELECT {cols} FROM (
 SELECT *, {days} AS days_left,
  CASE WHEN {days} < 0 THEN 'SCADUTO' WHEN {days} <= 1 THEN 'SCADENZA_IMMINENTE' END AS alert
 FROM task WHERE 1 = 1 {where}
 ORDER BY due_date ASC NULLS LAST,
  CASE priority WHEN 'ALTA' THEN 1 WHEN 'MEDIA' THEN 2 WHEN 'BASSA' THEN 3 END DESC,
  created_at DESC, task_id ASC {lim})"""


def q_task_stats(kind: str) -> str:
    period = "CAST(created_at AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
    if kind == "assignee":
        return with_views(TASK) + f"""
SELECT COALESCE(assignee, 'NON_ASSEGNATO') AS group_name, CAST(COUNT(*) AS BIGINT) AS total
FROM task WHERE {period} GROUP BY assignee"""
    return with_views(TASK) + f"""
SELECT {kind} AS group_name, CAST(COUNT(*) AS BIGINT) AS total FROM task WHERE {period} GROUP BY {kind}"""


def q_tasks_done_last_week() -> str:
    return with_views(TASK) + """
SELECT CAST(COUNT(*) AS BIGINT) AS completed FROM task
WHERE status = 'COMPLETATO' AND updated_at >= TIMESTAMP '1998-12-31 00:00:00' - INTERVAL 7 DAY"""


def q_audit_ops_by_type() -> str:
    return with_views(AUDIT) + """
SELECT op_type, CAST(COUNT(*) AS BIGINT) AS operations FROM audit_log GROUP BY op_type"""


def q_inventory_violations() -> str:
    return with_views(INVENTORY) + """
SELECT item_id, violations FROM (
 SELECT item_id, concat_ws(',',
  CASE WHEN name IS NULL THEN 'NAME_MISSING' END,
  CASE WHEN length(name) > 255 THEN 'NAME_TOO_LONG' END,
  CASE WHEN quantity IS NULL OR quantity < 0 THEN 'QUANTITY_INVALID' END,
  CASE WHEN unit IS NULL OR unit NOT IN ('PEZZI','KG','LITRI','GRAMMI') THEN 'UNIT_INVALID' END,
  CASE WHEN category IS NULL OR category NOT IN ('LATTICINI','VERDURE','FRUTTA','CARNE','PESCE','CONSERVE','BEVANDE','ALTRO')
       THEN 'CATEGORY_INVALID' END,
  CASE WHEN location IS NULL OR location NOT IN ('FRIGO','FREEZER','DISPENSA','CANTINA') THEN 'LOCATION_INVALID' END,
  CASE WHEN opened_date < CAST(created_at AS DATE) THEN 'OPENED_BEFORE_CREATED' END,
  CASE WHEN price < 0 THEN 'PRICE_NEGATIVE' END,
  CASE WHEN length(supplier) > 255 THEN 'SUPPLIER_TOO_LONG' END,
  CASE WHEN length(lot) > 100 THEN 'LOT_TOO_LONG' END,
  CASE WHEN updated_by IS NULL THEN 'UPDATED_BY_MISSING' END) AS violations
 FROM inventory) WHERE violations <> ''"""


def q_task_violations() -> str:
    return with_views(TASK) + """
SELECT task_id, violations FROM (
 SELECT task_id, concat_ws(',',
  CASE WHEN title IS NULL THEN 'TITLE_MISSING' END,
  CASE WHEN length(title) > 500 THEN 'TITLE_TOO_LONG' END,
  CASE WHEN priority IS NULL OR priority NOT IN ('ALTA','MEDIA','BASSA') THEN 'PRIORITY_INVALID' END,
  CASE WHEN status IS NULL OR status NOT IN ('DA_FARE','IN_CORSO','COMPLETATO','ANNULLATO') THEN 'STATUS_INVALID' END,
  CASE WHEN frequency IS NOT NULL AND frequency NOT IN ('GIORNALIERA','SETTIMANALE','MENSILE') THEN 'FREQUENCY_INVALID' END,
  CASE WHEN recurring AND frequency IS NULL THEN 'RECURRING_WITHOUT_FREQUENCY' END,
  CASE WHEN NOT recurring AND frequency IS NOT NULL THEN 'FREQUENCY_WITHOUT_RECURRING' END,
  CASE WHEN length(assignee) > 100 THEN 'ASSIGNEE_TOO_LONG' END,
  CASE WHEN created_by IS NULL THEN 'CREATED_BY_MISSING' END) AS violations
 FROM task) WHERE violations <> ''"""


def q_fk_orphans() -> str:
    return with_views(INVENTORY, CONSUMPTION, TASK) + """
SELECT 'consumption.item_id' AS reference, item_id AS missing_key, CAST(COUNT(*) AS BIGINT) AS rows
FROM consumption c WHERE NOT EXISTS (SELECT 1 FROM inventory i WHERE i.item_id = c.item_id) GROUP BY item_id
UNION ALL
SELECT 'task.parent_task_id', parent_task_id, CAST(COUNT(*) AS BIGINT)
FROM task t WHERE parent_task_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM task p WHERE p.task_id = t.parent_task_id) GROUP BY parent_task_id"""


def q_duplicate_keys() -> str:
    parts = []
    for name, key in (("inventory", "item_id"), ("task", "task_id"), ("consumption", "consumption_id"),
                      ("audit_log", "log_id")):
        parts.append(f"SELECT '{name}' AS table_name, {key} AS key, CAST(COUNT(*) AS BIGINT) AS copies "
                     f"FROM {name} GROUP BY {key} HAVING COUNT(*) > 1")
    return with_views(INVENTORY, TASK, CONSUMPTION, AUDIT) + "\nUNION ALL\n".join(parts)


def q_cascade_delete() -> str:
    return with_views(INVENTORY, CONSUMPTION) + f"""
SELECT consumption_id, item_id, CAST(qty AS DOUBLE) AS qty, {iso_ts('consumed_at')} AS consumed_at, reason, note
FROM consumption c WHERE NOT EXISTS (SELECT 1 FROM inventory i WHERE i.item_id = c.item_id AND i.quantity = 0)"""


def q_consumption_without_exhausted() -> str:
    return with_views(INVENTORY, CONSUMPTION) + _cons_stats(
        "i.category", "consumption c JOIN inventory i ON c.item_id = i.item_id AND i.quantity <> 0", "GROUP BY i.category")


def q_search_counts(text: str) -> str:
    pat = text.replace("'", "''")
    match = " OR ".join(f"contains(lower({c}), lower('{pat}'))" for c in ("name", "category", "location"))
    where = f"({match})" if text else "false"
    return with_views(INVENTORY) + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(least(COUNT(*), 10) AS BIGINT) AS shown FROM inventory WHERE {where}"""


def q_search_json(text: str) -> str:
    match = " OR ".join(f"contains(lower({c}), lower('{text}'))" for c in ("name", "category", "location"))
    return with_views(INVENTORY) + f"""
SELECT 'alimento-' || CAST(item_id AS VARCHAR) AS search_id, json_object('id', 'alimento-' || CAST(item_id AS VARCHAR),
  'title', name || ' (' || CAST(quantity AS VARCHAR) || ' ' || unit || ')', 'category', category, 'location', location)::VARCHAR AS json
FROM inventory WHERE {match}"""


def q_fetch_json() -> str:
    return f"""
SELECT request_id, CASE WHEN found THEN json_object('id', request_id, 'name', name, 'quantity', quantity, 'category', category,
  'location', location, 'expiry_date', expiry_date, 'created', created, 'modified', modified)::VARCHAR
  ELSE '{{"error":"NOT_FOUND"}}' END AS json FROM ({q_item_fetch()})"""


def q_consumption_stats_json() -> str:
    return f"""
WITH g AS ({q_consumption("category")})
SELECT group_name, json_object('gruppo', group_name, 'totale_consumato', total_qty, 'numero_operazioni', operations,
  'media_giornaliera', daily_mean)::VARCHAR AS json FROM g
UNION ALL
SELECT NULL, json_object('data_inizio', '1996-01-01', 'data_fine', '1998-12-31', 'raggruppa_per', 'categoria',
  'giorni_periodo', {CONS_DAYS}, 'totale_consumi', CAST(sum(total_qty) AS DOUBLE))::VARCHAR FROM g"""


def q_task_stats_json() -> str:
    return f"""
WITH g AS ({q_task_stats("assignee")})
SELECT group_name, json_object('gruppo', group_name, 'totale', total)::VARCHAR AS json FROM g
UNION ALL
SELECT NULL, json_object('data_inizio', '1998-01-01', 'data_fine', '1998-12-31', 'raggruppa_per', 'assegnatario',
  'totale_task', CAST(sum(total) AS BIGINT))::VARCHAR FROM g"""


def q_expiring_counts() -> str:
    return with_views(INVENTORY) + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(COUNT(*) AS BIGINT) AS shown FROM inventory
WHERE expiry_date IS NOT NULL AND expiry_date <= {AS_OF} + INTERVAL 3 DAY AND quantity > 0"""


def q_audit_rows() -> str:
    return with_views(AUDIT) + f"""
SELECT log_id, op_type, table_name, record_id, details, actor, {iso_ts("ts")} AS ts FROM audit_log"""


def q_task_stats_rollup() -> str:
    period = "CAST(created_at AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
    return with_views(TASK) + f"""
, g AS (SELECT status AS group_name, COUNT(*) AS total FROM task WHERE {period} GROUP BY status)
SELECT group_name, CAST(total AS BIGINT) AS total, false AS is_total FROM g
UNION ALL
SELECT NULL, CAST(COALESCE(SUM(total), 0) AS BIGINT), true FROM g"""


def q_consumption_default_period() -> str:
    """Thirty days back from 1998-12-31, both ends included."""
    return q_consumption("reason").replace("DATE '1996-01-01'", "DATE '1998-12-01'").replace("1096", "31")


def q_task_stats_default_period() -> str:
    return q_task_stats("status").replace("DATE '1998-01-01' AND DATE '1998-12-31'", "DATE '1998-05-31' AND DATE '1998-06-30'")


def q_stock_counts() -> str:
    return with_views(INVENTORY) + """
SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(least(COUNT(*), 50) AS BIGINT) AS shown FROM inventory WHERE quantity > 0"""


def q_task_counts() -> str:
    return with_views(TASK) + """
SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(least(COUNT(*), 50) AS BIGINT) AS shown FROM task"""


UNCLEAN_INVENTORY = """unclean_inventory AS (SELECT * REPLACE (
  CASE WHEN item_id % 17 = 0 THEN NULL WHEN item_id % 19 = 0 THEN repeat('n', 256) ELSE name END AS name,
  CAST(CASE WHEN item_id % 23 = 0 THEN -1 ELSE quantity END AS DECIMAL(10,3)) AS quantity,
  CASE WHEN item_id % 29 = 0 THEN 'LITRO' ELSE unit END AS unit,
  CASE WHEN item_id % 31 = 0 THEN 'MEAT' ELSE category END AS category,
  CASE WHEN item_id % 37 = 0 THEN 'ATTIC' ELSE location END AS location,
  CASE WHEN item_id % 41 = 0 THEN -1 ELSE price END AS price,
  CASE WHEN item_id % 43 = 0 THEN repeat('s', 256) ELSE supplier END AS supplier,
  CASE WHEN item_id % 47 = 0 THEN repeat('l', 101) ELSE lot END AS lot,
  CASE WHEN item_id % 53 = 0 THEN NULL ELSE updated_by END AS updated_by) FROM inventory)"""

UNCLEAN_TASK = """unclean_task AS (SELECT * REPLACE (
  CASE WHEN task_id % 17 = 0 THEN NULL WHEN task_id % 19 = 0 THEN repeat('t', 501) ELSE title END AS title,
  CASE WHEN task_id % 23 = 0 THEN 'HIGH' ELSE priority END AS priority,
  CASE WHEN task_id % 29 = 0 THEN 'OPEN' ELSE status END AS status,
  CASE WHEN task_id % 31 = 0 THEN 'ANNUALE' WHEN task_id % 37 = 0 THEN 'MENSILE' WHEN task_id % 41 = 0 THEN NULL
       ELSE frequency END AS frequency,
  CASE WHEN task_id % 37 = 0 THEN false WHEN task_id % 41 = 0 THEN true ELSE recurring END AS recurring,
  CASE WHEN task_id % 43 = 0 THEN repeat('a', 101) ELSE assignee END AS assignee,
  CASE WHEN task_id % 47 = 0 THEN NULL ELSE created_by END AS created_by,
  CASE WHEN task_id % 7 = 0 THEN -task_id WHEN task_id % 11 = 0 THEN task_id ELSE parent_task_id END AS parent_task_id) FROM task)"""

UNCLEAN_CONSUMPTION = """unclean_consumption AS (SELECT * REPLACE (
  CASE WHEN consumption_id % 13 = 0 THEN -item_id ELSE item_id END AS item_id) FROM consumption)"""


def q_unclean_inventory_violations() -> str:
    return (q_inventory_violations().replace(INVENTORY, INVENTORY + ",\n" + UNCLEAN_INVENTORY)
            .replace("FROM inventory) WHERE", "FROM unclean_inventory) WHERE"))


def q_unclean_task_violations() -> str:
    return (q_task_violations().replace(TASK, TASK + ",\n" + UNCLEAN_TASK)
            .replace("FROM task) WHERE", "FROM unclean_task) WHERE"))


def q_unclean_fk_orphans() -> str:
    return (q_fk_orphans().replace(TASK, TASK + ",\n" + UNCLEAN_TASK + ",\n" + UNCLEAN_CONSUMPTION)
            .replace("FROM consumption c", "FROM unclean_consumption c").replace("FROM task ", "FROM unclean_task "))
