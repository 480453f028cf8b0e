"""The registered queries: each reads the driver's tables at ``sf_dir`` through the
adapters, runs one operator over the whole tables, and returns the response-edge
projection (decimals as doubles, dates and timestamps as ISO text).

Parameters are fixed per key (they are the test's arguments, not row caps): the
stock reference date, the consumption and task periods, the search text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.expressions import to_response
from ..functions.running import numbered
from ..operators import audit, consumption, day_sums, deletes, quality, search_index, stock, tasks
from ..operators.apply import apply_job
from ..session import scratch_path
from ..sources import adapters as A
from ..sources import bucketed, tables
from ..sources import unclean as U

Query = Callable[[SparkSession, str], DataFrame]

# Fixed test arguments.
AS_OF = A.STOCK_AS_OF                      # stock reads
TASK_AS_OF = dt.date(1998, 12, 31)         # task reads
TASK_NOW = dt.datetime(1998, 12, 31)
CONS_START, CONS_END = dt.date(1996, 1, 1), dt.date(1998, 12, 31)
TASK_START, TASK_END = dt.date(1998, 1, 1), dt.date(1998, 12, 31)
TASK_STATS_END = dt.date(1998, 6, 30)
SEARCH_TEXT = "ring"
# Arrival waves: calls and audit rows arrive in three bursts split by time.
LEDGER_WAVES = (dt.datetime(1997, 1, 1), dt.datetime(1999, 1, 1))
AUDIT_WAVES = (dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 15))

QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def view(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A canonical view over the driver tables. Nothing is kept between queries: each
    query lists the files as they are when it is built."""
    return build()


def inv(spark, d):
    return view(spark, d, "inventory", lambda: A.inventory_from_part(A.read_table(spark, d, "part")))


def cons(spark, d):
    return view(spark, d, "consumption", lambda: A.consumption_from_lineitem(A.read_table(spark, d, "lineitem")))


def tsk(spark, d):
    return view(spark, d, "task", lambda: A.task_from_orders(A.read_table(spark, d, "orders")))


def aud(spark, d):
    return view(spark, d, "audit_log", lambda: A.audit_from_events(A.read_table(spark, d, "events")))


# --- stock ---------------------------------------------------------------------------

@register("expiring_items")
def q_expiring_items(spark, d):
    """Items expiring within 3 days of the reference date (expired included)."""
    return to_response(stock.expiring_items(inv(spark, d), AS_OF, days=3))


@register("stock_list")
def q_stock_list(spark, d):
    """First page (50) of the stock list."""
    return to_response(stock.list_stock(inv(spark, d), AS_OF))


@register("stock_alerts")
def q_stock_alerts(spark, d):
    """Days left and alert of every item in stock (the list without its limit)."""
    return to_response(stock.list_stock(inv(spark, d), AS_OF, limit=None, sort=False)
                       .select("item_id", "days_left", "alert"))


@register("stock_filtered")
def q_stock_filtered(spark, d):
    """The stock list under all four optional filters, no limit."""
    return to_response(stock.list_stock(inv(spark, d), AS_OF, category="LATTICINI", location="FRIGO",
                                        expiring_days=10, min_quantity=5, limit=None))


@register("stock_kpis")
def q_stock_kpis(spark, d):
    return to_response(stock.stock_kpis(inv(spark, d), AS_OF))


@register("expiring_filtered")
def q_expiring_filtered(spark, d):
    return to_response(stock.expiring_items(inv(spark, d), AS_OF, days=7, category="LATTICINI",
                                            location="FRIGO"))


@register("expiring_bands")
def q_expiring_bands(spark, d):
    return to_response(stock.expiring_bands(inv(spark, d), AS_OF, days=3)
                       .select("item_id", "days_left", "band"))


@register("expiring_band_counts")
def q_expiring_band_counts(spark, d):
    return to_response(stock.expiring_band_counts(inv(spark, d), AS_OF, days=3))


@register("items_per_category")
def q_items_per_category(spark, d):
    return stock.items_per_category(inv(spark, d))


@register("item_search")
def q_item_search(spark, d):
    return stock.search_items(inv(spark, d), SEARCH_TEXT)


def fetch_requests(lineitem: DataFrame) -> DataFrame:
    """One fetch request per lineitem row: the item of the row, a missing item on
    line 7, and a malformed id on line 6."""
    ln = F.col("l_linenumber")
    return lineitem.select(
        F.when(ln == 6, F.concat(F.lit("item-"), F.col("l_partkey").cast("string")))
        .when(ln == 7, F.concat(F.lit("alimento-"), (-F.col("l_partkey")).cast("string")))
        .otherwise(F.concat(F.lit("alimento-"), F.col("l_partkey").cast("string"))).alias("id"))


@register("item_fetch")
def q_item_fetch(spark, d):
    return stock.fetch_items(inv(spark, d), fetch_requests(A.read_table(spark, d, "lineitem")))


# --- consumption ---------------------------------------------------------------------

@register("consumption_by_category")
def q_cons_category(spark, d):
    return to_response(consumption.consumption_stats(cons(spark, d), inv(spark, d), CONS_START, CONS_END,
                                                     "categoria"))


@register("consumption_by_reason")
def q_cons_reason(spark, d):
    return to_response(consumption.consumption_stats(cons(spark, d), inv(spark, d), CONS_START, CONS_END,
                                                     "motivo"))


@register("consumption_default_period")
def q_cons_default_period(spark, d):
    """Only the end given: thirty days back from it."""
    return to_response(consumption.consumption_stats(cons(spark, d), inv(spark, d), end=CONS_END, group_by="motivo"))


@register("consumption_total")
def q_cons_total(spark, d):
    return to_response(consumption.consumption_stats(cons(spark, d), inv(spark, d), CONS_START, CONS_END,
                                                     "totale"))


@register("consumption_rollup")
def q_cons_rollup(spark, d):
    return to_response(consumption.consumption_rollup(cons(spark, d), inv(spark, d), CONS_START, CONS_END,
                                                      "categoria"))


# --- tasks and audit -----------------------------------------------------------------

@register("task_list")
def q_task_list(spark, d):
    return to_response(tasks.list_tasks(tsk(spark, d), TASK_AS_OF))


@register("task_alerts")
def q_task_alerts(spark, d):
    return to_response(tasks.list_tasks(tsk(spark, d), TASK_AS_OF, limit=None, sort=False)
                       .select("task_id", "days_left", "alert"))


@register("task_filtered")
def q_task_filtered(spark, d):
    return to_response(tasks.list_tasks(tsk(spark, d), TASK_AS_OF, status="DA_FARE", priority="ALTA",
                                        assignee="user_2", due_days=30, recurring=False, limit=None))


@register("task_stats_status")
def q_task_stats_status(spark, d):
    return tasks.task_stats(tsk(spark, d), TASK_START, TASK_END, "stato")


@register("task_stats_priority")
def q_task_stats_priority(spark, d):
    return tasks.task_stats(tsk(spark, d), TASK_START, TASK_END, "priorita")


@register("task_stats_assignee")
def q_task_stats_assignee(spark, d):
    return tasks.task_stats(tsk(spark, d), TASK_START, TASK_END, "assegnatario")


@register("task_stats_default_period")
def q_task_stats_default_period(spark, d):
    """Only the end given: thirty days back from it."""
    return tasks.task_stats(tsk(spark, d), end=TASK_STATS_END, group_by="stato")


@register("task_stats_rollup")
def q_task_stats_rollup(spark, d):
    """Tasks per status plus the total over the statuses."""
    return tasks.task_stats_rollup(tsk(spark, d), TASK_START, TASK_END, "stato")


@register("tasks_done_last_week")
def q_tasks_done_last_week(spark, d):
    return tasks.tasks_done_last_week(tsk(spark, d), TASK_NOW)


@register("audit_ops_by_type")
def q_audit_ops_by_type(spark, d):
    return audit.ops_by_type(aud(spark, d))


# --- quality -------------------------------------------------------------------------

@register("inventory_violations")
def q_inventory_violations(spark, d):
    return quality.inventory_violations(inv(spark, d))


@register("task_violations")
def q_task_violations(spark, d):
    return quality.task_violations(tsk(spark, d))


@register("fk_orphans")
def q_fk_orphans(spark, d):
    return quality.fk_orphans(inv(spark, d), cons(spark, d), tsk(spark, d))


@register("unclean_inventory_violations")
def q_unclean_inventory_violations(spark, d):
    """The stock rules over the unclean stock (every code occurs)."""
    return quality.inventory_violations(U.inventory(inv(spark, d)))


@register("unclean_task_violations")
def q_unclean_task_violations(spark, d):
    return quality.task_violations(U.tasks(tsk(spark, d)))


@register("unclean_fk_orphans")
def q_unclean_fk_orphans(spark, d):
    return quality.fk_orphans(inv(spark, d), U.consumption(cons(spark, d)), U.tasks(tsk(spark, d)))


@register("duplicate_keys")
def q_duplicate_keys(spark, d):
    return quality.duplicate_keys({"inventory": inv(spark, d), "task": tsk(spark, d),
                                   "consumption": cons(spark, d), "audit_log": aud(spark, d)})


@register("cascade_delete")
def q_cascade_delete(spark, d):
    """Delete the exhausted items; the consumption facts that survive the cascade."""
    i = inv(spark, d)
    _, facts = quality.cascade_delete(i, cons(spark, d), i.filter(F.col("quantity") == 0))
    return to_response(facts)


# --- writes --------------------------------------------------------------------------

from ..operators import commands as W  # noqa: E402
from ..sources import commands as C  # noqa: E402


def _orders(spark, d):
    return A.read_table(spark, d, "orders")


def _outcome_view(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("seq", "key", "ok", "code")


def _cmd(spark, d, name, build):
    return view(spark, d, f"commands:{name}", build)


def job_insert_items(spark, d):
    cmds = _cmd(spark, d, "insert_items", lambda: C.insert_items_from_part(A.read_table(spark, d, "part")))
    return W.insert_items(inv(spark, d), cmds, C.INSERT_NOW)


def job_update_items(spark, d):
    cmds = _cmd(spark, d, "update_items", lambda: C.update_items_from_orders(_orders(spark, d)))
    return W.update_items(inv(spark, d), cmds, C.INSERT_NOW)


def job_insert_tasks(spark, d):
    cmds = _cmd(spark, d, "insert_tasks", lambda: C.insert_tasks_from_customer(A.read_table(spark, d, "customer")))
    return W.insert_tasks(tsk(spark, d), cmds, C.TASK_NOW)


def job_update_tasks(spark, d):
    cmds = _cmd(spark, d, "update_tasks", lambda: C.update_tasks_from_orders(_orders(spark, d)))
    return W.update_tasks(tsk(spark, d), cmds, C.TASK_NOW)


def job_complete_tasks(spark, d):
    cmds = _cmd(spark, d, "complete_tasks", lambda: C.complete_tasks_from_orders(_orders(spark, d)))
    return W.complete_tasks(tsk(spark, d), cmds, C.TASK_NOW)


def job_cancel_tasks(spark, d):
    cmds = _cmd(spark, d, "cancel_tasks", lambda: C.cancel_tasks_from_orders(_orders(spark, d)))
    return W.cancel_tasks(tsk(spark, d), cmds, C.TASK_NOW)


@register("item_insert")
def q_item_insert(spark, d):
    """Rows added by inserting one item per part (faults planted by key)."""
    return to_response(job_insert_items(spark, d).added)


@register("item_insert_rejects")
def q_item_insert_rejects(spark, d):
    return job_insert_items(spark, d).outcomes.filter(~F.col("ok")).select("seq", "code")


@register("item_update")
def q_item_update(spark, d):
    """The stock table after one update call per order (several per item)."""
    return to_response(job_update_items(spark, d).table)


@register("item_update_outcomes")
def q_item_update_outcomes(spark, d):
    return _outcome_view(job_update_items(spark, d).outcomes)


@register("task_insert")
def q_task_insert(spark, d):
    return to_response(job_insert_tasks(spark, d).added)


@register("task_insert_rejects")
def q_task_insert_rejects(spark, d):
    return job_insert_tasks(spark, d).outcomes.filter(~F.col("ok")).select("seq", "code")


@register("task_update")
def q_task_update(spark, d):
    return to_response(job_update_tasks(spark, d).table)


@register("task_update_outcomes")
def q_task_update_outcomes(spark, d):
    return _outcome_view(job_update_tasks(spark, d).outcomes)


@register("task_complete")
def q_task_complete(spark, d):
    """Outcome of each completion call (two per task, first wins)."""
    return _outcome_view(job_complete_tasks(spark, d).outcomes)


@register("task_respawn")
def q_task_respawn(spark, d):
    """Next occurrences of the recurring tasks completed by those calls."""
    return to_response(job_complete_tasks(spark, d).added)


@register("task_complete_table")
def q_task_complete_table(spark, d):
    return to_response(job_complete_tasks(spark, d).table)


@register("task_cancel")
def q_task_cancel(spark, d):
    return to_response(job_cancel_tasks(spark, d).table.select("task_id", "status", "updated_by", "updated_at"))


@register("task_cancel_outcomes")
def q_task_cancel_outcomes(spark, d):
    return _outcome_view(job_cancel_tasks(spark, d).outcomes)


@register("audit_append")
def q_audit_append(spark, d):
    """The audit log with the rows of the item-update, task-update, completion and
    cancel jobs of one batch appended (ids = max + call order)."""
    rows = (job_update_items(spark, d).audit
            .unionByName(job_update_tasks(spark, d).audit)
            .unionByName(job_complete_tasks(spark, d).audit)
            .unionByName(job_cancel_tasks(spark, d).audit))
    return to_response(audit.append_audit(aud(spark, d), rows))


@register("audit_inserts")
def q_audit_inserts(spark, d):
    """The audit rows of the two insert jobs in one call-number space."""
    rows = (job_insert_items(spark, d).audit.withColumn("seq", F.col("seq") * 2)
            .unionByName(job_insert_tasks(spark, d).audit.withColumn("seq", F.col("seq") * 2 + 1)))
    return to_response(audit.numbered_audit(aud(spark, d), rows))


@register("item_insert_applied")
def q_item_insert_applied(spark, d):
    """The insert job applied to the tables (stock and audit log written once), and the
    stock read back."""
    root = scratch_path(spark, "tables")
    cmds = C.insert_items_from_part(A.read_table(spark, d, "part"))
    apply_job(W.insert_items(inv(spark, d), cmds, C.INSERT_NOW, store=True), root, "inventory", "1", aud(spark, d))
    return to_response(tables.read(spark, root, "inventory", "1"))


@register("item_update_applied")
def q_item_update_applied(spark, d):
    """The update calls applied to the stock table stored by buckets (only buckets of
    changed items are rewritten), and the table read back."""
    root = scratch_path(spark, "tables")
    bucketed.write(inv(spark, d), root, "inventory", buckets=16)
    bucketed.apply_changes(spark, root, "inventory", C.update_items_from_orders(_orders(spark, d)),
                           lambda table, calls: W.update_items(table, calls, C.INSERT_NOW, store=True), buckets=16)
    return to_response(bucketed.read(spark, root, "inventory").drop("bucket"))


@register("task_cancel_applied")
def q_task_cancel_applied(spark, d):
    """The cancel calls applied to the stored task table."""
    root = scratch_path(spark, "tables")
    bucketed.write(tsk(spark, d), root, "task", buckets=16)
    bucketed.apply_changes(spark, root, "task", C.cancel_tasks_from_orders(_orders(spark, d)),
                           lambda table, calls: W.cancel_tasks(table, calls, C.TASK_NOW, store=True), buckets=16)
    return to_response(bucketed.read(spark, root, "task").select("task_id", "status", "updated_by", "updated_at"))


def _stored_facts(spark, d) -> str:
    """The facts in two batches, each with its day sums, below a new folder."""
    root = scratch_path(spark, "tables")
    early = F.col("consumed_at") < F.lit(LEDGER_WAVES[0])
    for batch, part in (("1", F.coalesce(early, F.lit(True))), ("2", ~early)):
        facts = cons(spark, d).filter(part)
        tables.append_facts(facts, root, "consumption", every="month")
        day_sums.add_facts(facts, root, batch)
    return root


@register("cascade_delete_applied")
def q_cascade_delete_applied(spark, d):
    """The exhausted items deleted from the stored facts (only folders that hold their
    facts are rewritten); the facts read back."""
    root = _stored_facts(spark, d)
    deletes.delete_facts(spark, root, inv(spark, d).filter("quantity = 0"), "delete-1", every="month")
    return to_response(tables.read(spark, root, "consumption"))


@register("consumption_by_category_maintained")
def q_consumption_by_category_maintained(spark, d):
    """Consumption by category from day sums, after two batches of facts and the deletion
    of the exhausted items."""
    root = _stored_facts(spark, d)
    gone = inv(spark, d).filter("quantity = 0")
    day_sums.take_back(spark, root, gone, "delete-1")
    left = quality.without_items(inv(spark, d), gone)
    return to_response(day_sums.consumption_stats(spark, root, left, CONS_START, CONS_END, "categoria"))


@register("consumption_by_reason_maintained")
def q_consumption_by_reason_maintained(spark, d):
    """Consumption by reason from day sums of two batches of facts."""
    return to_response(day_sums.consumption_stats(spark, _stored_facts(spark, d), inv(spark, d), CONS_START, CONS_END, "motivo"))


@register("item_search_indexed")
def q_item_search_indexed(spark, d):
    """The search through trigram postings."""
    path = scratch_path(spark, "postings")
    search_index.write(inv(spark, d), path)
    return search_index.search(spark, path, inv(spark, d), SEARCH_TEXT)


@register("item_search_empty")
def q_item_search_empty(spark, d):
    """An empty search finds nothing."""
    return stock.search_items(inv(spark, d), "")


@register("search_counts")
def q_search_counts(spark, d):
    """Items that match the search, and items shown."""
    return stock.search_counts(inv(spark, d), SEARCH_TEXT)


@register("search_counts_empty")
def q_search_counts_empty(spark, d):
    return stock.search_counts(inv(spark, d), "")


@register("expiring_counts")
def q_expiring_counts(spark, d):
    """The number of expiring items in the answer."""
    return stock.list_counts(stock.expiring_items(inv(spark, d), AS_OF, days=3, sort=False), None)


@register("search_json")
def q_search_json(spark, d):
    """All matches of the search as the JSON documents of the answer."""
    return stock.search_json(stock.search_items(inv(spark, d), SEARCH_TEXT, None))


@register("fetch_json")
def q_fetch_json(spark, d):
    """Every fetch request's JSON document."""
    return stock.fetch_json(stock.fetch_items(inv(spark, d), fetch_requests(A.read_table(spark, d, "lineitem"))))


@register("consumption_stats_json")
def q_consumption_stats_json(spark, d):
    stats = consumption.consumption_stats(cons(spark, d), inv(spark, d), CONS_START, CONS_END, "categoria", sort=False)
    return consumption.stats_json(stats, CONS_START, CONS_END, "categoria")


@register("task_stats_json")
def q_task_stats_json(spark, d):
    stats = tasks.task_stats(tsk(spark, d), TASK_START, TASK_END, "assegnatario", sort=False)
    return tasks.stats_json(stats, TASK_START, TASK_END, "assegnatario")


@register("stock_list_json")
def q_stock_list_json(spark, d):
    """The stock list (no limit) as the JSON documents of the list answer."""
    return stock.stock_list_json(stock.list_stock(inv(spark, d), AS_OF, limit=None, sort=False))


@register("stock_counts")
def q_stock_counts(spark, d):
    """The two counts of the list answer: rows under the filters, rows shown (the page)."""
    return stock.list_counts(stock.in_stock(inv(spark, d), AS_OF))


@register("task_counts")
def q_task_counts(spark, d):
    return stock.list_counts(tasks.filter_tasks(tsk(spark, d), TASK_AS_OF))


@register("task_list_json")
def q_task_list_json(spark, d):
    """The task list (no limit) as the JSON documents of the list answer."""
    return tasks.task_list_json(tasks.list_tasks(tsk(spark, d), TASK_AS_OF, limit=None, sort=False))


@register("expiring_json")
def q_expiring_json(spark, d):
    """The expiring items with their band, as JSON documents."""
    return stock.expiring_json(stock.expiring_bands(inv(spark, d), AS_OF, days=3))


# --- ledger --------------------------------------------------------------------------

from ..operators import ledger as L  # noqa: E402

LEDGER_NOW = dt.datetime(1998, 12, 31)
_OUT_COLS = ("item_id", "l_orderkey", "l_linenumber", "l_suppkey", "qty", "forced", "ok", "code",
             "balance_before", "balance_after")


def _consume_cmds(spark, d):
    return _cmd(spark, d, "consume", lambda: A.consume_commands_from_lineitem(A.read_table(spark, d, "lineitem")))


def job_consume(spark, d):
    return L.consume(inv(spark, d), _consume_cmds(spark, d), LEDGER_NOW, A.LINEITEM_LEDGER_ORDER)


@register("consume_outcomes")
def q_consume_outcomes(spark, d):
    """Every lineitem row as a consume request, in ledger order per item."""
    return to_response(job_consume(spark, d).outcomes.select(*_OUT_COLS))


@register("consume_outcomes_phased")
def q_consume_outcomes_phased(spark, d):
    """The same ledger with every item treated as one that exceeds a task: all levels
    as scans over chunks of the call order."""
    res = L.consume(inv(spark, d), _consume_cmds(spark, d), LEDGER_NOW, A.LINEITEM_LEDGER_ORDER, rows_per_task=0)
    return to_response(res.outcomes.select(*_OUT_COLS))


@register("consume_unclean")
def q_consume_unclean(spark, d):
    """Unclean calls (unknown, missing and null items, bad quantities and reasons) on
    unclean stock: every refusal occurs."""
    res = L.consume(U.inventory(inv(spark, d)), U.consume_calls(_consume_cmds(spark, d)), LEDGER_NOW, A.LINEITEM_LEDGER_ORDER)
    return to_response(res.outcomes.select(*_OUT_COLS))


def job_consume_numbered(spark, d):
    """The ledger over calls numbered in their order: ids of facts and audit rows."""
    calls = numbered(_consume_cmds(spark, d), (*A.LINEITEM_LEDGER_ORDER, "item_id"))
    return L.consume(inv(spark, d), calls, LEDGER_NOW, A.LINEITEM_LEDGER_ORDER, consumption=cons(spark, d))


@register("consume_facts")
def q_consume_facts(spark, d):
    """The consumption facts that the ledger adds (ids unique, above those in use)."""
    return to_response(job_consume_numbered(spark, d).facts)


@register("consume_audit")
def q_consume_audit(spark, d):
    """The audit rows that the ledger adds."""
    return to_response(audit.numbered_audit(aud(spark, d), job_consume_numbered(spark, d).audit))


@register("consume_applied_facts")
def q_consume_applied_facts(spark, d):
    """The ledger applied to the tables (stock, facts and audit log written once), and the
    facts read back from their day folders."""
    root = scratch_path(spark, "tables")
    calls = numbered(_consume_cmds(spark, d), (*A.LINEITEM_LEDGER_ORDER, "item_id"))
    job = L.consume(inv(spark, d), calls, LEDGER_NOW, A.LINEITEM_LEDGER_ORDER, consumption=cons(spark, d), store=True)
    apply_job(job, root, "inventory", "1", aud(spark, d), every="month")
    return to_response(tables.read(spark, root, "consumption"))


@register("consume_ledger")
def q_consume_ledger(spark, d):
    """Opening and closing balance, accepted and rejected requests per item."""
    return to_response(L.ledger_balances(job_consume(spark, d).outcomes))


@register("consume_stock_table")
def q_consume_stock_table(spark, d):
    """The inventory after the ledger: new balances, last actor, change time."""
    return to_response(job_consume(spark, d).table.select("item_id", "quantity", "updated_by", "updated_at"))


@register("consume_forced")
def q_consume_forced(spark, d):
    """The same requests all forced."""
    out = L.consume_forced(inv(spark, d), _consume_cmds(spark, d), LEDGER_NOW, A.LINEITEM_LEDGER_ORDER)
    return to_response(out.select(*_OUT_COLS))


@register("consume_forced_chunked")
def q_consume_forced_chunked(spark, d):
    """The same forced requests through the general ledger, its levels as scans over
    chunks of the call order for every item."""
    forced = _consume_cmds(spark, d).withColumn("force", F.lit(True))
    res = L.consume(inv(spark, d), forced, LEDGER_NOW, A.LINEITEM_LEDGER_ORDER, rows_per_task=0)
    return to_response(res.outcomes.select(*_OUT_COLS))


def discard_commands(lineitem: DataFrame) -> DataFrame:
    """Every lineitem row as a discard call (never forced). Its reason follows the
    return flag: R → BUTTATO and N → SCADUTO are accepted reasons, A → CONSUMATO is
    refused by a discard."""
    return A.consume_commands_from_lineitem(lineitem).drop("force")


@register("discard_ledger")
def q_discard_ledger(spark, d):
    out = L.discard(inv(spark, d), discard_commands(A.read_table(spark, d, "lineitem")), LEDGER_NOW,
                    A.LINEITEM_LEDGER_ORDER).outcomes
    return to_response(out.select(*_OUT_COLS))


# --- streams -------------------------------------------------------------------------

from ..streaming import ledger_stream as ST  # noqa: E402



def _waves(df: DataFrame, col: str, cuts) -> list[DataFrame]:
    c = F.col(col)
    out, lo = [], None
    for hi in list(cuts) + [None]:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (c >= F.lit(lo))
        if hi is not None:
            cond = cond & (c < F.lit(hi))
        if lo is None:
            cond = cond | c.isNull()   # rows without a time arrive first
        out.append(df.filter(cond))
        lo = hi
    return out


@register("stream_ledger")
def q_stream_ledger(spark, d):
    """The lineitem consume calls arriving in three waves through the ledger stream
    (balance snapshots per micro-batch, restart from checkpoint between waves); balances
    per item."""
    base = scratch_path(spark, "stream-ledger")
    src, out, ckpt = f"{base}/source", f"{base}/ledger", f"{base}/checkpoint"
    cmds = _consume_cmds(spark, d)
    schema = cmds.schema
    for wave in _waves(cmds, "consumed_at", LEDGER_WAVES):
        wave.write.mode("append").parquet(src)
        ST.ledger_stream(spark, inv(spark, d), src, schema, out, ckpt, A.LINEITEM_LEDGER_ORDER).awaitTermination()
    return to_response(L.ledger_balances(ST.read_outcomes(spark, out)))


def _stream_accepted(spark, d) -> str:
    """The ledger stream with facts and audit rows; returns its folder."""
    base = scratch_path(spark, "stream-rows")
    src, out, ckpt = f"{base}/source", f"{base}/ledger", f"{base}/checkpoint"
    cmds = _consume_cmds(spark, d)
    rows = ST.AcceptedRows(cons(spark, d), aud(spark, d), LEDGER_NOW, (*A.LINEITEM_LEDGER_ORDER, "item_id"), "month")
    for wave in _waves(cmds, "consumed_at", LEDGER_WAVES):
        wave.write.mode("append").parquet(src)
        ST.ledger_stream(spark, inv(spark, d), src, cmds.schema, out, ckpt, A.LINEITEM_LEDGER_ORDER, rows=rows).awaitTermination()
    return out


@register("stream_facts")
def q_stream_facts(spark, d):
    """The consumption facts that the ledger stream writes, ids handed out across
    micro-batches without a gap."""
    return to_response(tables.read(spark, _stream_accepted(spark, d), "consumption"))


@register("stream_consume_audit")
def q_stream_consume_audit(spark, d):
    """The audit rows that the ledger stream writes."""
    return to_response(tables.read(spark, _stream_accepted(spark, d), "audit_log"))


def _audit_sink(spark, d) -> str:
    """The audit rows in three waves through the append sink; returns its folder."""
    base = scratch_path(spark, "stream-sink")
    src, sink, ckpt = f"{base}/source", f"{base}/audit_log", f"{base}/checkpoint"
    rows = aud(spark, d)
    for wave in _waves(rows, "ts", AUDIT_WAVES):
        wave.write.mode("append").parquet(src)
        ST.audit_sink_stream(spark, src, rows.schema, sink, ckpt, every="month").awaitTermination()
    return base


@register("stream_audit_rows")
def q_stream_audit_rows(spark, d):
    """The audit rows that arrived in three waves, read back from the append sink."""
    return to_response(tables.read(spark, _audit_sink(spark, d), "audit_log"))


@register("stream_audit_sink_counts")
def q_stream_audit_sink_counts(spark, d):
    """Operations per type, complete mode, over a stream that reads the append sink."""
    base = _audit_sink(spark, d)
    ST.audit_count_stream(spark, f"{base}/audit_log", S.AUDIT_LOG, f"{base}/counts", f"{base}/counts-checkpoint").awaitTermination()
    return ST.read_audit_counts(spark, f"{base}/counts")


@register("stream_audit")
def q_stream_audit(spark, d):
    """The audit rows arriving in three waves; operations per type, complete mode."""
    base = scratch_path(spark, "stream-audit")
    src, out, ckpt = f"{base}/source", f"{base}/counts", f"{base}/checkpoint"
    rows = aud(spark, d)
    for wave in _waves(rows, "ts", AUDIT_WAVES):
        wave.write.mode("append").parquet(src)
        ST.audit_count_stream(spark, src, rows.schema, out, ckpt).awaitTermination()
    return ST.read_audit_counts(spark, out)
