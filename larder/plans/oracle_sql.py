"""Registered oracle SQL, one entry per key of ``catalog.QUERIES`` that SQL can express."""

from __future__ import annotations

from . import oracle as O

_DAYS = "datediff('day', DATE '2024-01-15', expiry_date)"
_TDAYS = "datediff('day', DATE '1998-12-31', due_date)"

ORACLE: dict[str, str] = {
    "expiring_items": O.q_expiring_items(3),
    "stock_list": O.q_stock_list(),
    "stock_alerts": O.q_stock_list(limit=None, cols="item_id, CAST(datediff('day', DATE '2024-01-15', expiry_date) AS BIGINT) AS days_left, alert"),
    "stock_filtered": O.q_stock_list(
        where="AND category = 'LATTICINI' AND location = 'FRIGO' AND quantity >= 5 "
              "AND expiry_date IS NOT NULL AND expiry_date <= DATE '2024-01-15' + INTERVAL 10 DAY", limit=None),
    "stock_kpis": O.q_stock_kpis(),
    "expiring_filtered": O.q_expiring_filtered(),
    "expiring_bands": O.q_expiring_bands(),
    "expiring_band_counts": O.q_expiring_band_counts(),
    "items_per_category": O.q_items_per_category(),
    "item_search": O.q_item_search("ring"),
    "item_fetch": O.q_item_fetch(),
    "consumption_by_category": O.q_consumption("category"),
    "consumption_by_reason": O.q_consumption("reason"),
    "consumption_total": O.q_consumption("total"),
    "consumption_rollup": O.q_consumption_rollup(),
    "task_list": O.q_task_list(),
    "task_alerts": O.q_task_list(limit=None, cols="task_id, CAST(days_left AS BIGINT) AS days_left, alert"),
    "task_filtered": O.q_task_list(
        where="AND status = 'DA_FARE' AND priority = 'ALTA' AND assignee = 'user_2' AND due_date IS NOT NULL "
              "AND due_date <= DATE '1998-12-31' + INTERVAL 30 DAY AND recurring = false", limit=None),
    "task_stats_status": O.q_task_stats("status"),
    "task_stats_priority": O.q_task_stats("priority"),
    "task_stats_assignee": O.q_task_stats("assignee"),
    "task_stats_rollup": O.q_task_stats_rollup(),
    "tasks_done_last_week": O.q_tasks_done_last_week(),
    "audit_ops_by_type": O.q_audit_ops_by_type(),
    "inventory_violations": O.q_inventory_violations(),
    "task_violations": O.q_task_violations(),
    "fk_orphans": O.q_fk_orphans(),
    "duplicate_keys": O.q_duplicate_keys(),
    "cascade_delete": O.q_cascade_delete(),
}

from . import oracle_writes as OW  # noqa: E402

ORACLE.update({
    "item_insert": OW.q_item_insert(),
    "item_insert_rejects": OW.q_item_insert_rejects(),
    "item_update": OW.q_item_update(),
    "item_update_outcomes": OW.q_item_update_outcomes(),
    "task_insert": OW.q_task_insert(),
    "task_insert_rejects": OW.q_task_insert_rejects(),
    "task_update": OW.q_task_update(),
    "task_update_outcomes": OW.q_task_update_outcomes(),
    "task_complete": OW.q_task_complete(),
    "task_respawn": OW.q_task_respawn(),
    "task_complete_table": OW.q_task_complete_table(),
    "task_cancel": OW.q_task_cancel(),
    "task_cancel_outcomes": OW.q_task_cancel_outcomes(),
    "audit_append": OW.q_audit_append(),
    "stock_list_json": OW.q_stock_list_json(),
})

from . import oracle_ledger as OL  # noqa: E402

ORACLE.update({
    "consume_outcomes": OL.q_consume_outcomes(),
    "consume_outcomes_phased": OL.q_consume_outcomes(),
    "consume_ledger": OL.q_consume_ledger(),
    "consume_stock_table": OL.q_consume_stock_table(),
    "consume_forced": OL.q_consume_forced(),
    "consume_forced_chunked": OL.q_consume_forced(),
    "discard_ledger": OL.q_discard_ledger(),
})

ORACLE.update({
    "stream_ledger": OL.q_consume_ledger(),
    "stream_audit": O.q_audit_ops_by_type(),
})

ORACLE.update({
    "consumption_default_period": O.q_consumption_default_period(),
    "task_stats_default_period": O.q_task_stats_default_period(),
    "stock_counts": O.q_stock_counts(),
    "task_counts": O.q_task_counts(),
    "task_list_json": OW.q_task_list_json(),
    "expiring_json": OW.q_expiring_json(),
    "unclean_inventory_violations": O.q_unclean_inventory_violations(),
    "unclean_task_violations": O.q_unclean_task_violations(),
    "unclean_fk_orphans": O.q_unclean_fk_orphans(),
    "consume_unclean": OL.q_consume_unclean(),
    "consume_facts": OL.q_consume_facts(),
    "consume_audit": OL.q_consume_audit(),
    "audit_inserts": OW.q_audit_inserts(),
    "item_insert_applied": OW.q_item_insert_applied(),
    "consume_applied_facts": OL.q_consume_facts(),
})

ORACLE.update({
    "item_update_applied": OW.q_item_update(),
    "task_cancel_applied": OW.q_task_cancel(),
    "cascade_delete_applied": O.q_cascade_delete(),
    "consumption_by_category_maintained": O.q_consumption_without_exhausted(),
    "consumption_by_reason_maintained": O.q_consumption("reason"),
    "item_search_indexed": O.q_item_search("ring"),
    "item_search_empty": O.q_item_search("ring").replace("WHERE", "WHERE false AND (").replace("ORDER BY", ") ORDER BY"),
    "search_counts": O.q_search_counts("ring"),
    "search_counts_empty": O.q_search_counts(""),
    "expiring_counts": O.q_expiring_counts(),
    "search_json": O.q_search_json("ring"),
    "fetch_json": O.q_fetch_json(),
    "consumption_stats_json": O.q_consumption_stats_json(),
    "task_stats_json": O.q_task_stats_json(),
    "stream_facts": OL.q_stream_facts(),
    "stream_consume_audit": OL.q_stream_consume_audit(),
    "stream_audit_rows": O.q_audit_rows(),
    "stream_audit_sink_counts": O.q_audit_ops_by_type(),
})
