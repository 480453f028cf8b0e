"""The stock ledger: consume and discard requests applied in call order.

A request for ``qty`` of an item with balance ``b`` is rejected (INSUFFICIENT)
when ``qty > b`` and it is not forced; otherwise it is accepted, a consumption
fact records the *requested* quantity, and the balance becomes
``max(0, b - qty)`` (EXHAUSTED when that is 0). A rejected request leaves the
balance alone, so each decision depends on the one before.

This greedy fill is computed by halving levels, exactly. With balance ``U`` at the
start of a level, forced requests and unforced ones with ``2q <= U`` are sure to be
accepted while the balance stays at ``U/2`` or above, so the balance is ``U`` minus
a running sum. The level ends at the first request that takes the balance below
``U/2``, or that is unforced, has ``2q > U`` and still fits; it is accepted, every
other large request before it is INSUFFICIENT, and the next level starts below
``U/2``. At balance 0 the rest is closed form. ``decimal(10,3)`` allows at most 34
levels.

Every item takes the same levels. Items whose requests fit a task (``rows_per_task``
rows) are settled side by side in numpy after one shuffle by item; the requests of
heavier items are range-partitioned by call order into chunks. A chunk takes all
levels of the items that begin in it; for items that go on into further chunks each
level is a two-level scan (totals per chunk, offsets over an item's chunks, running
sum inside a chunk) over the rows still open, so no task holds more than a chunk of
any item.
Both work on the same opening balances and the same rules, and tests hold both
against a sequential fold, on unclean stock too.

Opening balances: one row per item. Null or negative stock counts as 0; of several
stock rows with one id the least counts.

``ledger_balances``: opening and closing balance and counts per item, an aggregate
over the outcomes (the balance never rises, so the closing balance is the minimum).

Quantities are integer thousandths (``decimal(10,3)`` scale) inside, so all sums are
exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import expressions as X
from ..functions.running import running_sum
from ..session import stored
from .audit import audit_rows, payload
from .commands import first_failure

# The reasons a discard call accepts.
DISCARD_REASONS = ("SCADUTO", "BUTTATO")


@dataclass
class LedgerResult:
    outcomes: DataFrame      # one row per request: command columns + ok, code, balance_before/after
    table: DataFrame         # the inventory with the new balances
    _facts: DataFrame | None
    _audit: DataFrame | None

    @property
    def facts(self) -> DataFrame:
        """Consumption rows of the accepted requests."""
        return self._numbered(self._facts)

    @property
    def audit(self) -> DataFrame:
        """SCARICO_ALIMENTO rows of the accepted requests."""
        return self._numbered(self._audit)

    def _numbered(self, rows: DataFrame | None) -> DataFrame:
        if rows is None:
            raise ValueError("facts and audit rows take their ids from a unique call number: the commands need a seq column")
        return rows


def _k(col: Column) -> Column:
    """Decimal quantity → integer thousandths."""
    return (col.cast(S.QTY) * 1000).cast("bigint")


def _from_k(col: str) -> Column:
    return (F.col(col).cast("decimal(20,0)") / F.lit(1000)).cast(S.QTY)


def check_requests(commands: DataFrame, order_cols: Sequence[str], discard: bool) -> DataFrame:
    """Balance-independent checks. For a discard the reason must be SCADUTO or
    BUTTATO up front; for a consume an invalid reason only shows after the balance
    test (the fact insert is what fails), so it is carried as a flag."""
    cols = set(commands.columns)
    reason = F.coalesce(F.col("reason"), F.lit(S.DEFAULT_REASON)) if "reason" in cols else F.lit(S.DEFAULT_REASON)
    force = F.coalesce(F.col("force"), F.lit(False)) if ("force" in cols and not discard) else F.lit(False)
    q = F.col("qty")
    checks = [
        ("MISSING_FIELD", F.col("item_id").isNull() | (F.col("item_id") == 0) | q.isNull() | (q == 0)),
        ("NON_POSITIVE_QUANTITY", q < 0),
    ]
    if discard:
        checks.append(("INVALID_REASON", ~reason.isin(*DISCARD_REASONS)))
    return commands.select(
        "*",
        first_failure(checks).alias("_pre"),
        reason.isin(*S.REASONS).alias("_reason_ok"),
        reason.alias("_reason"),
        force.alias("_force"),
        _k(q).alias("_q_k"),
    )


# Requests of one item that a task settles on its own; the requests of an item with more
# are cut into chunks of the call order.
ROWS_PER_TASK = 1_000_000


def opening_balances(inventory: DataFrame) -> DataFrame:
    """(item_id, _open_k): one row per item. Null or negative stock counts as 0, of
    several rows with one id the least counts."""
    k = F.greatest(F.coalesce(_k(F.col("quantity")), F.lit(0)), F.lit(0))
    return inventory.filter(F.col("item_id").isNotNull()).select("item_id", k.alias("_open_k")).groupBy("item_id").agg(F.min("_open_k").alias("_open_k"))


def settle(segment: np.ndarray, opening: np.ndarray, q: np.ndarray, force: np.ndarray,
           valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Balances before and after each request. Rows are in call order inside their
    segment (one item); ``opening`` has one balance per segment."""
    before, after = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    balance = opening.astype(np.int64)
    rows = np.flatnonzero(balance[segment] > 0)   # at balance 0 nothing changes any more
    while len(rows):
        seg, qr = segment[rows], q[rows]
        u = balance[seg]
        small = valid[rows] & (force[rows] | (2 * qr <= u))
        taken = np.where(small, qr, 0)
        total = np.cumsum(taken)
        head = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        start = np.repeat(total[head] - taken[head], np.diff(np.r_[head, len(rows)]))
        left = u - (total - start)                # the balance after the row, inside the level
        here = left + taken
        end = np.flatnonzero((small & (2 * left < u)) | (valid[rows] & ~small & (qr <= here)))
        last = np.full(len(balance), len(rows), np.int64)
        np.minimum.at(last, seg[end], end)
        at = np.arange(len(rows))
        done = at <= last[seg]
        before[rows[done]], after[rows[done]] = here[done], left[done]
        stop = last[seg[head]]
        stop = stop[stop < len(rows)]             # the rows that end a level
        after[rows[stop]] = balance[seg[stop]] = np.maximum(0, here[stop] - qr[stop])
        rows = rows[~done]
        rows = rows[balance[segment[rows]] > 0]
    return before, after


def _settle_batches(batches):
    """Settle one partition, sorted by (item, opening row first, call order). The last
    item's balance is carried to the next Arrow batch; opening rows are dropped."""
    item = balance = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("item_id").to_numpy()
        is_open = batch.column("_kind").to_numpy() == 0
        new = np.r_[True, ids[1:] != ids[:-1]] | is_open
        segment, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        opening = batch.column("_open_k").fill_null(0).to_numpy()[starts]
        known = is_open[starts]
        if not known[0] and balance is not None and ids[0] == item:
            opening, known = np.r_[balance, opening[1:]], np.r_[True, known[1:]]
        keep = np.flatnonzero(~is_open)
        part = batch.take(pa.array(keep))
        before, after = settle(
            segment[keep], opening, part.column("_q_k").fill_null(0).to_numpy(), part.column("_force").to_numpy(zero_copy_only=False),
            part.column("_pre").is_null().to_numpy(zero_copy_only=False) & part.column("_reason_ok").to_numpy(zero_copy_only=False))
        missing = ~known[segment[keep]]
        item, balance = ids[-1], int(opening[-1]) if known[-1] else None
        if balance is not None and not is_open[-1]:
            balance = int(after[-1])
        for name, values in (("_before_k", before), ("_after_k", after)):
            part = part.append_column(name, pa.array(values, pa.int64(), mask=missing))
        yield part


_BALANCES = [T.StructField("_before_k", T.LongType()), T.StructField("_after_k", T.LongType())]


def _with_opening(opening: DataFrame, checked: DataFrame) -> DataFrame:
    """The requests and, as rows of ``_kind`` 0, the opening balances."""
    req = checked.select(F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_open_k"), "*")
    return req.unionByName(opening.select(F.lit(0).alias("_kind"), "_open_k", "item_id"), allowMissingColumns=True)


def _by_item(opening: DataFrame, checked: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """The requests with their balances, settled item by item after one shuffle."""
    ordered = _with_opening(opening, checked).repartition("item_id").sortWithinPartitions("item_id", "_kind", *order_cols)
    return ordered.mapInArrow(_settle_batches, T.StructType([*ordered.schema.fields, *_BALANCES])).drop("_kind", "_open_k")


def _settle_chunk(batches):
    """Settle one chunk as ``_settle_batches`` does. ``_begun`` marks the requests of an item
    that began in an earlier chunk: their balances are still open."""
    begun = []

    def watched():
        for batch in batches:
            if batch.num_rows and not begun:
                begun.append(batch.column("item_id")[0].as_py() if batch.column("_kind")[0].as_py() else None)
            yield batch

    for part in _settle_batches(watched()):
        ids = part.column("item_id").to_numpy()
        yield part.append_column("_begun", pa.array(np.full(len(ids), False) if begun[0] is None else ids == begun[0]))


def _by_level(opening: DataFrame, checked: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """The requests with their balances, settled over chunks of the call order. The pass
    that cuts the chunks takes all levels of every item as far as the chunk in which it
    begins; it moves and writes each request once. Only items that go on into the next
    chunks are left (a chunk begins with one such item at most): they take one level at
    a time over their chunks, in narrow rows and with one row per chunk to join. Settled
    rows of a level go to the shared folder; the next level reads only the rows that are
    still open."""
    columns, order = checked.columns, ("item_id", "_kind", *order_cols)
    placed = (_with_opening(opening, checked).repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_chunk", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()))
    placed = stored(placed.mapInArrow(_settle_chunk, T.StructType(
        [*placed.schema.fields, *_BALANCES, T.StructField("_begun", T.BooleanType())])).drop("_kind", "_open_k"), "ledger-placed")
    out = placed.filter(~F.col("_begun")).select(*columns, "_before_k", "_after_k")
    going_on = placed.filter("_begun")
    # at most one item per chunk: a table of its own, whose size shows that nothing else need move to meet it
    items = stored(going_on.select("item_id").distinct(), "ledger-going-on")
    if items.isEmpty():
        return out
    # the balance never rises: the least one of an item's first chunk is the one it goes on with
    so_far = out.join(items, "item_id", "left_semi").groupBy("item_id").agg(F.min("_after_k").alias("_so_far"))
    start = (items.join(opening.join(items, "item_id", "left_semi"), "item_id", "left").join(so_far, "item_id", "left")
             .select("item_id", F.coalesce("_so_far", "_open_k").alias("_u")))
    valid = F.col("_pre").isNull() & F.col("_reason_ok")
    level = going_on.select("item_id", "_chunk", "_pos", "_q_k", "_force", valid.alias("_valid")).join(start, "item_id")
    settled: list[DataFrame] = []
    valid, u, q, here, left = F.col("_valid"), F.col("_u"), F.col("_q_k"), F.col("_here"), F.col("_left")
    small = valid & (F.col("_force") | (2 * q <= u))
    inside = Window.partitionBy("item_id", "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    chunks_before = Window.partitionBy("item_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        # an unknown item (null) and an empty one need no running sum
        rows = level.withColumn("_taken", F.when(small & (u > 0), q).otherwise(F.lit(0)))
        totals = rows.groupBy("item_id", "_chunk").agg(F.sum("_taken").alias("_t"))
        offsets = totals.select("item_id", "_chunk", F.coalesce(F.sum("_t").over(chunks_before), F.lit(0)).alias("_offset"))
        scanned = (rows.join(offsets, ["item_id", "_chunk"])
                   .withColumn("_left", u - F.col("_offset") - F.sum("_taken").over(inside))
                   .withColumn("_here", F.col("_left") + F.col("_taken")))
        ends = (u > 0) & ((small & (2 * left < u)) | (valid & ~small & (q <= here)))
        first = (scanned.filter(ends).groupBy("item_id")
                 .agg(F.min(F.struct("_pos", F.greatest(F.lit(0), here - q).alias("after"))).alias("_end")))
        step = stored(scanned.join(first, "item_id", "left").drop("_taken", "_offset"), "ledger-level")
        stop = F.col("_end._pos")
        now = step.filter(stop.isNull() | (F.col("_pos") <= stop))
        settled.append(now.select("_pos", here.alias("_before_k"),
                                  F.when(F.col("_pos") == stop, F.col("_end.after")).otherwise(left).alias("_after_k")))
        level = step.filter(F.col("_pos") > stop).withColumn("_u", F.col("_end.after")).drop("_here", "_left", "_end")
        if level.isEmpty():
            break
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    return out.unionByName(going_on.select(*columns, "_pos").join(found, "_pos").drop("_pos"))


def decided(balances: DataFrame) -> DataFrame:
    """``_ok`` and ``_code`` from the balance before each request."""
    q, before = F.col("_q_k"), F.col("_before_k")
    code = (F.when(F.col("_pre").isNotNull(), F.col("_pre"))
            .when(before.isNull(), F.lit("NOT_FOUND"))
            .when((q > before) & ~F.col("_force"), F.lit("INSUFFICIENT"))
            .when(~F.col("_reason_ok"), F.lit("INVALID_REASON"))
            .when(F.col("_after_k") == 0, F.lit("EXHAUSTED")).otherwise(F.lit("OK")))
    return balances.withColumn("_code", code).withColumn("_ok", F.col("_code").isin("EXHAUSTED", "OK"))


def requests_per_item(checked: DataFrame) -> DataFrame:
    """(item_id, count) over the requests that name an item."""
    return checked.filter(F.col("item_id").isNotNull()).groupBy("item_id").count()


def plan_outcomes(inventory: DataFrame, checked: DataFrame, order_cols: Sequence[str],
                  rows_per_task: int = ROWS_PER_TASK, counts: DataFrame | None = None) -> DataFrame:
    """Every request with ``_before_k``, ``_after_k``, ``_ok`` and ``_code``. Which items
    exceed a task is counted over all requests (one partial row per item and task), or
    taken from ``counts`` (``requests_per_item``) where the caller has them."""
    opening = opening_balances(inventory)
    counts = requests_per_item(checked) if counts is None else counts
    # calls without an item have no balance; however many, they need no shuffle
    nameless = checked.filter(F.col("item_id").isNull()).select(
        "*", *[F.lit(None).cast("bigint").alias(f.name) for f in _BALANCES])
    checked = checked.filter(F.col("item_id").isNotNull())
    if rows_per_task < 1:   # every item has more
        return decided(_by_level(opening, checked, order_cols).unionByName(nameless))
    heavy = counts.filter(F.col("count") > rows_per_task).select("item_id")
    heavy = stored(heavy, "ledger-heavy")
    if heavy.isEmpty():
        return decided(_by_item(opening, checked, order_cols).unionByName(nameless))
    heavy_rows = checked.join(heavy, "item_id", "left_semi")
    rest = checked.join(heavy, "item_id", "left_anti")
    by_level = _by_level(opening.join(heavy, "item_id", "left_semi"), heavy_rows, order_cols)
    by_item = _by_item(opening.join(heavy, "item_id", "left_anti"), rest, order_cols)
    return decided(by_item.unionByName(by_level).unionByName(nameless))


def _finish(inventory: DataFrame, folded: DataFrame, commands: DataFrame, order_cols: Sequence[str],
            now, consumption: DataFrame | None) -> LedgerResult:
    outcomes = _outcomes(folded, commands.columns)
    accepted = outcomes.filter(F.col("ok"))
    ts = X.ts_lit(now)
    next_id = (F.coalesce(consumption.select(F.max("consumption_id")).scalar(), F.lit(0))
               if consumption is not None else F.lit(0))
    if "seq" not in commands.columns:
        return LedgerResult(outcomes, _new_stock(inventory, accepted, order_cols, ts), None, None)
    return LedgerResult(outcomes, _new_stock(inventory, accepted, order_cols, ts), fact_rows(accepted, next_id, now), consume_audit(accepted, now))


def _outcomes(folded: DataFrame, cmd_cols: Sequence[str]) -> DataFrame:
    """The requests with their codes and balances, as a caller sees them."""
    return folded.select(
        *cmd_cols, F.col("_reason").alias("effective_reason"), F.col("_force").alias("forced"),
        F.col("_ok").alias("ok"), F.col("_code").alias("code"),
        _from_k("_before_k").alias("balance_before"), _from_k("_after_k").alias("balance_after"))


def fact_rows(accepted: DataFrame, base: Column, now) -> DataFrame:
    """The consumption facts of accepted requests; ids are ``base + seq``."""
    ts = X.ts_lit(now)
    when_col = F.coalesce(F.col("consumed_at"), ts) if "consumed_at" in accepted.columns else ts
    note = F.col("note") if "note" in accepted.columns else F.lit(None).cast("string")
    return accepted.select(
        (base + F.col("seq")).alias("consumption_id"), "item_id", F.col("qty").cast(S.QTY).alias("qty"),
        when_col.alias("consumed_at"), F.col("effective_reason").alias("reason"), note.alias("note"))


def consume_audit(accepted: DataFrame, now) -> DataFrame:
    """The audit rows of accepted requests, numbered by ``seq``."""
    src = accepted if "actor" in accepted.columns else accepted.withColumn("actor", F.lit(None).cast("string"))
    # fixed values: field names of the audit payload
    return audit_rows(src, S.OP_CONSUME_ITEM, S.TABLE_ITEMS, F.col("item_id"), payload(
        quantita_prima=F.col("balance_before").cast("double"), quantita_consumata=F.col("qty").cast("double"),
        quantita_dopo=F.col("balance_after").cast("double"), motivo=F.col("effective_reason"),
        forzato=F.col("forced")), now)


def _new_stock(inventory: DataFrame, accepted: DataFrame, order_cols: Sequence[str], ts: Column) -> DataFrame:
    """The inventory with the closing balances of the accepted requests."""
    order = F.struct(*[F.col(c) for c in order_cols])
    actor = F.col("actor") if "actor" in accepted.columns else F.lit(None).cast("string")
    closing = (accepted.select("item_id", "balance_after", order.alias("_o"), actor.alias("_actor"))
               .groupBy("item_id")
               .agg(F.min("balance_after").alias("_closing"), F.max_by("_actor", "_o").alias("_last_actor")))
    return inventory.join(closing, "item_id", "left").select(*[
        F.coalesce(F.col("_closing"), F.col("quantity")).cast(S.QTY).alias("quantity") if c == "quantity" else
        F.when(F.col("_closing").isNotNull(), ts).otherwise(F.col("updated_at")).alias("updated_at")
        if c == "updated_at" else
        F.when(F.col("_closing").isNotNull(), F.coalesce(F.col("_last_actor"), F.lit("unknown")))
        .otherwise(F.col("updated_by")).alias("updated_by") if c == "updated_by" else F.col(c)
        for c in inventory.columns])


def consume(inventory: DataFrame, commands: DataFrame, now, order_cols: Sequence[str] = ("seq",),
            consumption: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK, store: bool = False) -> LedgerResult:
    """Apply consume requests (``item_id, qty`` and optional ``reason`` (default
    CONSUMATO), ``note``, ``force``, ``actor``, ``consumed_at``) in ``order_cols``
    order per item. Codes: OK, EXHAUSTED (accepted, balance now 0), INSUFFICIENT,
    NOT_FOUND, MISSING_FIELD, NON_POSITIVE_QUANTITY, INVALID_REASON. New fact ids
    are ``max(consumption_id) + seq``; facts and audit rows need a unique ``seq``. With
    ``store=True`` the decisions go to the shared folder once and every frame of the
    result reads them there."""
    checked = check_requests(commands, order_cols, discard=False)
    folded = plan_outcomes(inventory, checked, order_cols, rows_per_task)
    folded = stored(folded, "ledger") if store else folded
    return _finish(inventory, folded, commands, order_cols, now, consumption)


def discard(inventory: DataFrame, commands: DataFrame, now, order_cols: Sequence[str] = ("seq",),
            consumption: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK, store: bool = False) -> LedgerResult:
    """Discard stock: a consume that is never forced and whose reason must be
    SCADUTO or BUTTATO (the declared behaviour, with the reason kept)."""
    checked = check_requests(commands, order_cols, discard=True)
    folded = plan_outcomes(inventory, checked, order_cols, rows_per_task)
    folded = stored(folded, "ledger") if store else folded
    return _finish(inventory, folded, commands, order_cols, now, consumption)


def consume_forced(inventory: DataFrame, commands: DataFrame, now, order_cols: Sequence[str] = ("seq",)) -> DataFrame:
    """Outcomes when every request is forced: no request depends on the one before, so the
    balance after it is ``max(0, b0 - S)`` with ``S`` the item's running sum."""
    checked = check_requests(commands.withColumn("force", F.lit(True)), order_cols, discard=False)
    valid = F.col("_pre").isNull() & F.col("_reason_ok")
    taken = F.when(valid, F.col("_q_k")).otherwise(F.lit(0))
    named = running_sum(checked.filter(F.col("item_id").isNotNull()), ["item_id"], order_cols, "_sum", taken)
    named = named.join(opening_balances(inventory), "item_id", "left")
    left = lambda used: F.when(F.col("_open_k").isNotNull(), F.greatest(F.lit(0), F.col("_open_k") - used))
    named = named.withColumn("_before_k", left(F.col("_sum") - taken)).withColumn("_after_k", left(F.col("_sum"))).drop("_sum", "_open_k")
    nameless = checked.filter(F.col("item_id").isNull()).select(
        "*", *[F.lit(None).cast("bigint").alias(f.name) for f in _BALANCES])
    return _outcomes(decided(named.unionByName(nameless)), commands.columns)


def ledger_balances(outcomes: DataFrame) -> DataFrame:
    """Per item: opening balance, closing balance, accepted and rejected requests.
    The balance never rises, so opening = max(before) and closing = min(after); a
    plain partial+final aggregate."""
    return outcomes.groupBy("item_id").agg(
        F.max("balance_before").alias("opening"), F.min("balance_after").alias("closing"),
        F.count_if(F.col("ok")).alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))
