"""Write calls re-aimed as set-based jobs.

Each job takes the current table and a frame of commands (one row per call, with
``seq`` = call order and ``actor``) and returns a ``JobResult``: the new table,
one outcome row per command (``seq, key, ok, code``), the audit rows of the
accepted calls, and the rows the job added. A rejected call changes nothing.

Shape of every job: the command frame is validated with column expressions,
joined once with the table on its key (a bulk key lookup), and the accepted
changes are reduced per key with a single aggregate (``max_by`` over ``seq``),
which combines map-side, so a key that receives a third of all commands is
collapsed before any shuffle of the table. The new table is one left join of the
table with that per-key change set. New ids are ``max(id) + seq``: unique,
increasing in call order, computed without a sort (gaps are allowed, as with a
database sequence); ``seq`` must be unique and positive within a batch.

With ``store=True`` the checked calls are written to the shared folder once, and every
frame of the result is derived from that table (see ``apply``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expressions as X
from ..session import stored
from .audit import audit_rows, payload

OK = "OK"


class JobResult:
    """The frames a job returns. Each is built on first access, so a caller that
    needs only the audit rows does not pay for planning the new table."""

    def __init__(self, table, outcomes, audit, added=None):
        self._makers = {"table": table, "outcomes": outcomes, "audit": audit, "added": added}
        self._built: dict[str, DataFrame | None] = {}

    def _get(self, name: str):
        if name not in self._built:
            maker = self._makers[name]
            self._built[name] = maker() if callable(maker) else maker
        return self._built[name]

    table = property(lambda self: self._get("table"))
    outcomes = property(lambda self: self._get("outcomes"))
    audit = property(lambda self: self._get("audit"))
    added = property(lambda self: self._get("added"))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """Code of the first failing check in order, null when all pass (null-safe)."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks])


def _not_in(col: Column, labels) -> Column:
    return col.isNotNull() & ~col.isin(*labels)


def _truthy_text(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def _too_long(col: Column, n: int) -> Column:
    return F.length(col) > n


def _rounded(dec: Column, scale: int) -> Column:
    """Round half away from zero to ``scale`` places, still wide (no overflow)."""
    return F.round(dec, scale)


def _fits(dec: Column, precision: int, scale: int) -> Column:
    return F.abs(dec) < F.lit(10 ** (precision - scale))


def _next_ids(table: DataFrame, key: str) -> Column:
    """``max(key)`` of the table as a scalar subquery (0 for an empty table)."""
    return F.coalesce(table.select(F.max(key)).scalar(), F.lit(0))


def _by_key(table: DataFrame, key: str, *columns: Column) -> DataFrame:
    """One row per key of a table (``_id`` and the given columns), so that every call finds
    at most one: of several rows with one id the least, column by column in their order."""
    if not columns:
        return table.select(F.col(key).alias("_k")).distinct().select(_own_shuffle("_k").alias("_id"))
    return table.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*columns)).alias("_row")).select(_own_shuffle("_k").alias("_id"), "_row.*")


def _own_shuffle(key: str) -> Column:
    """The key of an aggregate that becomes a side of a join. As a computed value it is
    shuffled once more (one row per key), and only a join whose sides are plain shuffles
    is split where one key has most of the calls."""
    return F.col(key).cast("string").cast("bigint")


def _outcomes(df: DataFrame, key: Column) -> DataFrame:
    return df.select("seq", key.cast("bigint").alias("key"), F.col("_code").isNull().alias("ok"),
                     F.coalesce(F.col("_code"), F.lit(OK)).alias("code"))


# --------------------------------------------------------------------------- items

def insert_items(inventory: DataFrame, commands: DataFrame, now, store: bool = False) -> JobResult:
    """Insert stock items (one command per call). Checks, first failure wins:
    missing field; unit, category, location not in their enums; quantity not a
    number or not > 0; expiry or opened date not ``YYYY-M-D``; opened date in the
    future; then the table rules: quantity or price out of range, price < 0, text
    too long, opened date before the insert date. A price of 0 is stored as null."""
    today = F.to_date(X.ts_lit(now))
    # parse once: the checks below refer to these columns many times
    c = commands.select("*", X.parse_decimal("quantity").alias("_qn"), X.parse_decimal("price").alias("_pn"),
                        X.strict_date("expiry_date").alias("_exp"), X.strict_date("opened_date").alias("_opened"))
    q, price, exp, opened = F.col("_qn"), F.col("_pn"), F.col("_exp"), F.col("_opened")
    has_exp = _truthy_text(F.col("expiry_date"))
    has_opened = _truthy_text(F.col("opened_date"))
    has_price = _truthy_text(F.col("price"))
    q3 = _rounded(q, 3)
    p2 = _rounded(price, 2)
    code = first_failure([
        ("MISSING_FIELD", F.col("name").isNull() | F.col("quantity").isNull() | F.col("unit").isNull()
         | F.col("category").isNull() | F.col("location").isNull()),
        ("INVALID_UNIT", _not_in(F.col("unit"), S.UNITS)),
        ("INVALID_CATEGORY", _not_in(F.col("category"), S.CATEGORIES)),
        ("INVALID_LOCATION", _not_in(F.col("location"), S.LOCATIONS)),
        ("INVALID_QUANTITY", q.isNull()),
        ("NON_POSITIVE_QUANTITY", q <= 0),
        ("INVALID_EXPIRY_DATE", has_exp & exp.isNull()),
        ("INVALID_OPENED_DATE", has_opened & opened.isNull()),
        ("OPENED_IN_FUTURE", has_opened & (opened > today)),
        ("NAME_TOO_LONG", _too_long(F.col("name"), S.MAX_LEN["name"])),
        ("QUANTITY_OUT_OF_RANGE", ~_fits(q3, 10, 3)),
        ("INVALID_PRICE", has_price & price.isNull()),
        ("PRICE_OUT_OF_RANGE", has_price & ~_fits(p2, 10, 2)),
        ("SUPPLIER_TOO_LONG", _too_long(F.col("supplier"), S.MAX_LEN["supplier"])),
        ("LOT_TOO_LONG", _too_long(F.col("lot"), S.MAX_LEN["lot"])),
        ("ACTOR_TOO_LONG", _too_long(F.col("actor"), S.MAX_LEN["updated_by"])),
        ("OPENED_BEFORE_INSERT", has_opened & (opened < today)),
        ("PRICE_NEGATIVE", has_price & (p2 < 0)),
    ])
    base = _next_ids(inventory, "item_id")
    checked = c.select("*", code.alias("_code"), (base + F.col("seq")).alias("_new_id"),
                       q3.alias("_q"), p2.alias("_p"))
    checked = stored(checked, "job") if store else checked
    ts = X.ts_lit(now)
    ok = checked.filter(F.col("_code").isNull())
    added = ok.select(
        F.col("_new_id").alias("item_id"), "name", F.col("_q").cast(S.QTY).alias("quantity"), "unit",
        F.when(has_exp, F.col("_exp")).alias("expiry_date"),
        F.when(has_opened, F.col("_opened")).alias("opened_date"),
        "category", "location",
        F.when(has_price & (F.col("_p") != 0), F.col("_p")).cast(S.PRICE).alias("price"),
        "supplier", "lot", ts.alias("created_at"), ts.alias("updated_at"),
        F.coalesce(F.col("actor"), F.lit("unknown")).alias("updated_by"),
    )
    audit = audit_rows(
        ok.withColumn("_qd", F.col("_q").cast(S.QTY).cast("double")), S.OP_INSERT_ITEM, S.TABLE_ITEMS,
        F.col("_new_id"),
        payload(nome=F.col("name"), quantita=F.col("_qd"), categoria=F.col("category"),
                  ubicazione=F.col("location")), now)
    return JobResult(lambda: inventory.select(*added.columns).unionByName(added),
                     lambda: _outcomes(checked, F.when(F.col("_code").isNull(), F.col("_new_id"))), audit, added)


# Argument names of the insert, update, complete and cancel calls, as the audit payload records them.
ITEM_ARG_NAMES = {"name": "nome", "quantity": "quantita", "expiry_date": "data_scadenza",
                  "opened_date": "data_apertura", "category": "categoria", "location": "ubicazione",
                  "price": "prezzo_acquisto", "supplier": "fornitore", "lot": "lotto_acquisto"}
TASK_ARG_NAMES = {"title": "titolo", "description": "descrizione", "priority": "priorita",
                  "status": "stato", "due_date": "data_scadenza", "assignee": "assegnatario"}


def _apply_changes(table: DataFrame, key: str, accepted: DataFrame, typed: dict[str, Column],
                   now) -> DataFrame:
    """Left join of the table with the per-key change set: for each field the value
    of the last accepted command (by ``seq``) that set it; ``updated_at`` := now
    and ``updated_by`` := the last actor on every changed row."""
    aggs = [F.max_by(F.col(f"_v_{f}"), F.when(F.col(f"_v_{f}").isNotNull(), F.col("seq"))).alias(f"_n_{f}")
            for f in typed]
    changes = (accepted.select(key, "seq", "actor", *[expr.alias(f"_v_{f}") for f, expr in typed.items()])
               .groupBy(key)
               .agg(*aggs, F.max_by("actor", "seq").alias("_actor"), F.lit(True).alias("_changed")))
    joined = table.join(changes, key, "left")
    cols = []
    for name in table.columns:
        if name in typed:
            cols.append(F.coalesce(F.col(f"_n_{name}"), F.col(name)).cast(table.schema[name].dataType).alias(name))
        elif name == "updated_at":
            cols.append(F.when(F.col("_changed"), X.ts_lit(now)).otherwise(F.col(name)).alias(name))
        elif name == "updated_by":
            cols.append(F.when(F.col("_changed"), F.coalesce(F.col("_actor"), F.lit("unknown")))
                        .otherwise(F.col(name)).alias(name))
        else:
            cols.append(F.col(name))
    return joined.select(*cols)


def update_items(inventory: DataFrame, commands: DataFrame, now, store: bool = False) -> JobResult:
    """Update stock items: any of 9 fields (not the unit); a null field keeps the
    old value, 0 is a value. Several calls on one item apply in ``seq`` order, so
    per field the last non-null value wins. Rejections: missing id, not found,
    nothing to update, malformed number or date, value outside an enum, a table
    rule broken by the new value (quantity < 0, price < 0, out of range, too long,
    opened before the insert date). The rules are checked on the values a call
    sets; the rest of the row is assumed to satisfy them (see ``quality``)."""
    fields = S.UPDATE_ITEM_FIELDS
    parsed = commands.select("*", X.parse_decimal("quantity").alias("_qn"), X.parse_decimal("price").alias("_pn"),
                             X.strict_date("expiry_date").alias("_exp"),
                             X.strict_date("opened_date").alias("_opened"))
    q, p, exp, opened = F.col("_qn"), F.col("_pn"), F.col("_exp"), F.col("_opened")
    inv = _by_key(inventory, "item_id", F.to_date("created_at").alias("_created"))
    joined = parsed.join(inv, parsed["item_id"] == inv["_id"], "left")
    code = first_failure([
        ("MISSING_ID", F.col("item_id").isNull() | (F.col("item_id") == 0)),
        ("NOT_FOUND", F.col("_id").isNull()),
        ("NOTHING_TO_UPDATE", ~F.greatest(*[F.col(f).isNotNull() for f in fields])),
        ("INVALID_QUANTITY", F.col("quantity").isNotNull() & q.isNull()),
        ("INVALID_PRICE", F.col("price").isNotNull() & p.isNull()),
        ("INVALID_EXPIRY_DATE", F.col("expiry_date").isNotNull() & exp.isNull()),
        ("INVALID_OPENED_DATE", F.col("opened_date").isNotNull() & opened.isNull()),
        ("NAME_TOO_LONG", _too_long(F.col("name"), S.MAX_LEN["name"])),
        ("QUANTITY_OUT_OF_RANGE", q.isNotNull() & ~_fits(_rounded(q, 3), 10, 3)),
        ("INVALID_CATEGORY", _not_in(F.col("category"), S.CATEGORIES)),
        ("INVALID_LOCATION", _not_in(F.col("location"), S.LOCATIONS)),
        ("PRICE_OUT_OF_RANGE", p.isNotNull() & ~_fits(_rounded(p, 2), 10, 2)),
        ("SUPPLIER_TOO_LONG", _too_long(F.col("supplier"), S.MAX_LEN["supplier"])),
        ("LOT_TOO_LONG", _too_long(F.col("lot"), S.MAX_LEN["lot"])),
        ("ACTOR_TOO_LONG", _too_long(F.col("actor"), S.MAX_LEN["updated_by"])),
        ("QUANTITY_NEGATIVE", _rounded(q, 3) < 0),
        ("OPENED_BEFORE_INSERT", opened < F.col("_created")),
        ("PRICE_NEGATIVE", _rounded(p, 2) < 0),
    ])
    checked = joined.select(*commands.columns, "_qn", "_pn", "_exp", "_opened", code.alias("_code"))
    checked = stored(checked, "job") if store else checked
    accepted = checked.filter(F.col("_code").isNull())
    typed = {
        "name": F.col("name"),
        "quantity": _rounded(q, 3).cast(S.QTY),
        "expiry_date": exp, "opened_date": opened,
        "category": F.col("category"), "location": F.col("location"),
        "price": _rounded(p, 2).cast(S.PRICE),
        "supplier": F.col("supplier"), "lot": F.col("lot"),
    }
    numeric = {"quantity": q.cast("double"), "price": p.cast("double")}
    details = F.to_json(F.struct(*[
        numeric.get(f, F.col(f)).alias(ITEM_ARG_NAMES[f]) for f in fields]))
    return JobResult(lambda: _apply_changes(inventory, "item_id", accepted, typed, now),
                     lambda: _outcomes(checked, F.col("item_id")),
                     lambda: audit_rows(accepted, S.OP_UPDATE_ITEM, S.TABLE_ITEMS, F.col("item_id"), details, now))


# --------------------------------------------------------------------------- tasks

def insert_tasks(task: DataFrame, commands: DataFrame, now, store: bool = False) -> JobResult:
    """Insert tasks. Checks, first failure wins: title missing or empty; priority or
    frequency not in its enum; recurring without frequency; due date not
    ``YYYY-M-D``; text too long. Priority defaults to MEDIA (also when null), status
    is DA_FARE, and the frequency is kept only on a recurring task."""
    commands = commands.select("*", X.strict_date("due_date").alias("_due"))
    due = F.col("_due")
    rec = F.coalesce(F.col("recurring"), F.lit(False))
    code = first_failure([
        ("MISSING_TITLE", ~_truthy_text(F.col("title"))),
        ("INVALID_PRIORITY", _not_in(F.col("priority"), S.PRIORITIES)),
        ("INVALID_FREQUENCY", _truthy_text(F.col("frequency")) & ~F.col("frequency").isin(*S.FREQUENCIES)),
        ("MISSING_FREQUENCY", rec & ~_truthy_text(F.col("frequency"))),
        ("INVALID_DUE_DATE", _truthy_text(F.col("due_date")) & due.isNull()),
        ("TITLE_TOO_LONG", _too_long(F.col("title"), S.MAX_LEN["title"])),
        ("ASSIGNEE_TOO_LONG", _too_long(F.col("assignee"), S.MAX_LEN["assignee"])),
        ("ACTOR_TOO_LONG", _too_long(F.col("actor"), S.MAX_LEN["created_by"])),
    ])
    base = _next_ids(task, "task_id")
    checked = commands.select("*", code.alias("_code"), (base + F.col("seq")).alias("_new_id"))
    checked = stored(checked, "job") if store else checked
    ok = checked.filter(F.col("_code").isNull())
    ts = X.ts_lit(now)
    actor = F.coalesce(F.col("actor"), F.lit("unknown"))
    added = ok.select(
        F.col("_new_id").alias("task_id"), "title", "description",
        F.coalesce(F.col("priority"), F.lit(S.DEFAULT_PRIORITY)).alias("priority"),
        F.lit(S.DEFAULT_STATUS).alias("status"),
        F.when(_truthy_text(F.col("due_date")), due).alias("due_date"),
        "assignee", rec.alias("recurring"),
        F.when(rec, F.col("frequency")).alias("frequency"),
        actor.alias("created_by"), ts.alias("created_at"), actor.alias("updated_by"), ts.alias("updated_at"),
        F.lit(None).cast("bigint").alias("parent_task_id"),
    )
    audit = audit_rows(
        ok.withColumn("_prio", F.coalesce(F.col("priority"), F.lit(S.DEFAULT_PRIORITY))),
        S.OP_INSERT_TASK, S.TABLE_TASKS, F.col("_new_id"),
        payload(titolo=F.col("title"), priorita=F.col("_prio")), now)
    return JobResult(lambda: task.select(*added.columns).unionByName(added),
                     lambda: _outcomes(checked, F.when(F.col("_code").isNull(), F.col("_new_id"))), audit, added)


def update_tasks(task: DataFrame, commands: DataFrame, now, store: bool = False) -> JobResult:
    """Update tasks: title, description, priority, status, due date, assignee; a
    null field keeps the old value and per field the last non-null value wins.
    Setting COMPLETATO here does not respawn a recurring task."""
    fields = S.UPDATE_TASK_FIELDS
    parsed = commands.select("*", X.strict_date("due_date").alias("_due"))
    due = F.col("_due")
    t = _by_key(task, "task_id")
    joined = parsed.join(t, parsed["task_id"] == t["_id"], "left")
    code = first_failure([
        ("MISSING_ID", F.col("task_id").isNull() | (F.col("task_id") == 0)),
        ("NOT_FOUND", F.col("_id").isNull()),
        ("NOTHING_TO_UPDATE", ~F.greatest(*[F.col(f).isNotNull() for f in fields])),
        ("INVALID_DUE_DATE", F.col("due_date").isNotNull() & due.isNull()),
        ("TITLE_TOO_LONG", _too_long(F.col("title"), S.MAX_LEN["title"])),
        ("INVALID_PRIORITY", _not_in(F.col("priority"), S.PRIORITIES)),
        ("INVALID_STATUS", _not_in(F.col("status"), S.STATUSES)),
        ("ASSIGNEE_TOO_LONG", _too_long(F.col("assignee"), S.MAX_LEN["assignee"])),
        ("ACTOR_TOO_LONG", _too_long(F.col("actor"), S.MAX_LEN["updated_by"])),
    ])
    checked = joined.select(*commands.columns, "_due", code.alias("_code"))
    checked = stored(checked, "job") if store else checked
    accepted = checked.filter(F.col("_code").isNull())
    typed = {f: (due if f == "due_date" else F.col(f)) for f in fields}
    details = F.to_json(F.struct(*[F.col(f).alias(TASK_ARG_NAMES[f]) for f in fields]))
    return JobResult(lambda: _apply_changes(task, "task_id", accepted, typed, now),
                     lambda: _outcomes(checked, F.col("task_id")),
                     lambda: audit_rows(accepted, S.OP_UPDATE_TASK, S.TABLE_TASKS, F.col("task_id"), details, now))


def respawn_due(due: Column, frequency: Column) -> Column:
    """Next due date of a recurring task: +1, +7 or +30 days; null stays null."""
    days = F.when(frequency == "GIORNALIERA", S.RESPAWN_DAYS["GIORNALIERA"]) \
        .when(frequency == "SETTIMANALE", S.RESPAWN_DAYS["SETTIMANALE"]) \
        .when(frequency == "MENSILE", S.RESPAWN_DAYS["MENSILE"])
    return F.date_add(due, days)


def complete_tasks(task: DataFrame, commands: DataFrame, now, store: bool = False) -> JobResult:
    """Complete tasks. The first call on a task that is not already COMPLETATO
    wins; later calls, and calls on completed tasks, get ALREADY_COMPLETED. A
    cancelled task can be completed. Completing a recurring task adds its next
    occurrence (``added``): same title, description, priority, assignee and
    frequency, due date moved on, created by the caller, parent = the old task.

    The first call per task is found with a ``min(seq)`` aggregate (combines
    map-side, so skew-proof) rather than a window over each task's calls."""
    t = _by_key(task, "task_id", F.col("status").alias("_status"), F.col("recurring").alias("_rec"))
    first = (commands.filter(F.col("task_id").isNotNull())
             .groupBy(F.col("task_id").alias("_f")).agg(F.min("seq").alias("_first"))
             .select(_own_shuffle("_f").alias("_fid"), "_first"))
    joined = (commands.join(t, commands["task_id"] == t["_id"], "left")
              .join(first, F.col("task_id") == F.col("_fid"), "left"))
    code = first_failure([
        ("MISSING_ID", F.col("task_id").isNull() | (F.col("task_id") == 0)),
        ("NOT_FOUND", F.col("_id").isNull()),
        ("ALREADY_COMPLETED", (F.col("_status") == S.COMPLETED) | (F.col("seq") != F.col("_first"))),
    ])
    base = _next_ids(task, "task_id")
    checked = joined.select(*commands.columns, "_rec", code.alias("_code"),
                            F.when(code.isNull() & F.col("_rec"), base + F.col("seq")).alias("_new_id"))
    checked = stored(checked, "job") if store else checked
    accepted = checked.filter(F.col("_code").isNull())
    ts = X.ts_lit(now)
    actor = F.coalesce(F.col("actor"), F.lit("unknown"))
    def build_added() -> DataFrame:
        src = task.select(*[F.col(c).alias(f"_o_{c}") for c in ("task_id", "title", "description", "priority",
                                                                    "due_date", "assignee", "frequency")])
        # one old row per id, whatever the table holds
        src = src.groupBy("_o_task_id").agg(F.min(F.struct(*[c for c in src.columns if c != "_o_task_id"])).alias("_o")).select("_o_task_id", "_o.*")
        spawn = accepted.filter(F.col("_rec")).join(src, F.col("task_id") == F.col("_o_task_id"))
        return spawn.select(
            F.col("_new_id").alias("task_id"), F.col("_o_title").alias("title"),
            F.col("_o_description").alias("description"), F.col("_o_priority").alias("priority"),
            F.lit(S.DEFAULT_STATUS).alias("status"),
            respawn_due(F.col("_o_due_date"), F.col("_o_frequency")).alias("due_date"),
            F.col("_o_assignee").alias("assignee"), F.lit(True).alias("recurring"),
            F.col("_o_frequency").alias("frequency"), actor.alias("created_by"), ts.alias("created_at"),
            actor.alias("updated_by"), ts.alias("updated_at"),
            F.col("task_id").cast("bigint").alias("parent_task_id"),
        )

    def build_table() -> DataFrame:
        done = accepted.select(F.col("task_id").alias("_cid"), actor.alias("_actor"))
        joined = task.join(done, task["task_id"] == done["_cid"], "left")
        hit = F.col("_cid").isNotNull()
        new = {"status": F.when(hit, F.lit(S.COMPLETED)).otherwise(F.col("status")),
               "updated_at": F.when(hit, ts).otherwise(F.col("updated_at")),
               "updated_by": F.when(hit, F.col("_actor")).otherwise(F.col("updated_by"))}
        current = joined.select(*[new.get(c, F.col(c)).alias(c) for c in task.columns])
        return current.unionByName(result.added)

    result = JobResult(
        build_table, lambda: _outcomes(checked, F.col("task_id")),
        lambda: audit_rows(accepted, S.OP_COMPLETE_TASK, S.TABLE_TASKS, F.col("task_id"),
                           payload(note_completamento=F.col("note"), ricorrente=F.col("_rec"),
                                   nuovo_task_id=F.col("_new_id")), now),
        build_added)
    return result


def cancel_tasks(task: DataFrame, commands: DataFrame, now, store: bool = False) -> JobResult:
    """Cancel tasks (soft delete): status ANNULLATO from any status, repeatable;
    a missing task is NOT_FOUND."""
    t = _by_key(task, "task_id")
    joined = commands.join(t, commands["task_id"] == t["_id"], "left")
    code = first_failure([
        ("MISSING_ID", F.col("task_id").isNull() | (F.col("task_id") == 0)),
        ("NOT_FOUND", F.col("_id").isNull()),
    ])
    checked = joined.select(*commands.columns, code.alias("_code"))
    checked = stored(checked, "job") if store else checked
    accepted = checked.filter(F.col("_code").isNull())
    typed = {"status": F.lit(S.CANCELLED)}
    return JobResult(lambda: _apply_changes(task, "task_id", accepted, typed, now),
                     lambda: _outcomes(checked, F.col("task_id")),
                     lambda: audit_rows(accepted, S.OP_CANCEL_TASK, S.TABLE_TASKS, F.col("task_id"),
                                        payload(motivo=F.col("reason")), now))
