"""Task reads: list with filters and alerts, statistics per group, recent completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expressions as X
from .consumption import in_period, period

# The grouping names of the task statistics (and English aliases).
GROUPS = {"stato": "status", "priorita": "priority", "assegnatario": "assignee",
          "status": "status", "priority": "priority", "assignee": "assignee"}


def _check(value, labels, what):
    if value and value not in labels:
        raise ValueError(f"invalid {what}: {value!r}")


def filter_tasks(task: DataFrame, as_of, status=None, priority=None, assignee=None,
                 due_days=None, recurring: bool | None = None) -> DataFrame:
    """Optional filters: status, priority, assignee and ``due_days`` apply when
    truthy (``due_days`` keeps overdue tasks and ignores status); ``recurring``
    applies whenever it is not None, so ``False`` filters too."""
    _check(status, S.STATUSES, "status")
    _check(priority, S.PRIORITIES, "priority")
    df = task
    if X.truthy(status):
        df = df.filter(F.col("status") == status)
    if X.truthy(priority):
        df = df.filter(F.col("priority") == priority)
    if X.truthy(assignee):
        df = df.filter(F.col("assignee") == assignee)
    if X.truthy(due_days):
        df = df.filter(F.col("due_date").isNotNull()
                       & (F.col("due_date") <= F.date_add(X.date_lit(as_of), int(due_days))))
    if recurring is not None:
        df = df.filter(F.col("recurring") == F.lit(bool(recurring)))
    return df


def list_tasks(task: DataFrame, as_of, status=None, priority=None, assignee=None, due_days=None,
               recurring: bool | None = None, limit: int | None = S.DEFAULT_LIMIT, sort: bool = True) -> DataFrame:
    """Tasks by due date (none last), then priority in *descending enum order*
    (BASSA, MEDIA, ALTA), then newest first, then id; with days left and alert."""
    df = filter_tasks(task, as_of, status, priority, assignee, due_days, recurring)
    days = X.days_left("due_date", as_of)
    df = df.select(
        "task_id", "title", "description", "priority", "status", "due_date",
        days.alias("days_left"), "assignee", "recurring", "frequency", "created_by",
        "created_at", "updated_at", X.task_alert(days).alias("alert"))
    if sort:
        df = df.orderBy(F.col("due_date").asc_nulls_last(), X.ordinal("priority", S.PRIORITIES).desc(),
                        F.col("created_at").desc(), F.col("task_id").asc())
    return df.limit(int(limit)) if limit is not None else df


def task_stats(task: DataFrame, start=None, end=None, group_by: str = "stato", as_of=None,
               sort: bool = True) -> DataFrame:
    """Tasks created in the period (both ends included) per status, priority or
    assignee. By assignee the grouping is on the raw column and the null group is
    labelled NON_ASSEGNATO afterwards, so a person of that name stays a row of its
    own."""
    if group_by not in GROUPS:
        raise ValueError(f"invalid grouping: {group_by!r}")
    kind = GROUPS[group_by]
    df = in_period(task, "created_at", *period(start, end, as_of))
    out = df.groupBy(kind).agg(F.count(F.lit(1)).alias("total"))
    label = F.coalesce(F.col(kind), F.lit(S.UNASSIGNED)) if kind == "assignee" else F.col(kind)
    out = out.select(label.alias("group_name"), "total")
    return out.orderBy(F.col("total").desc(), F.col("group_name")) if sort else out


def stats_json(stats: DataFrame, start, end, group_by: str) -> DataFrame:
    """The documents of the statistics answer (``group_name``, ``json``): one for each
    group, and one without a group that has the parameters and the number of tasks."""
    # fixed values: field names of the JSON answer
    group = F.struct(F.col("group_name").alias("gruppo"), F.col("total").alias("totale"))
    whole = F.struct(F.lit(str(start)).alias("data_inizio"), F.lit(str(end)).alias("data_fine"), F.lit(group_by).alias("raggruppa_per"),
                     F.coalesce(F.col("all"), F.lit(0)).alias("totale_task"))
    nulls = {"ignoreNullFields": "false"}
    return stats.select("group_name", F.to_json(group, nulls).alias("json")).unionByName(
        stats.agg(F.sum("total").alias("all")).select(F.lit(None).cast("string").alias("group_name"), F.to_json(whole, nulls).alias("json")))


def tasks_done_last_week(task: DataFrame, now) -> DataFrame:
    """Completed tasks whose last change is at most 7 days before ``now``."""
    since = X.ts_lit(now) - F.expr("INTERVAL 7 DAYS")
    return (task.filter((F.col("status") == S.COMPLETED) & (F.col("updated_at") >= since))
            .agg(F.count(F.lit(1)).alias("completed")))


def task_stats_rollup(task: DataFrame, start=None, end=None, group_by: str = "stato", as_of=None) -> DataFrame:
    """The groups of ``task_stats`` plus the grand total over them (``is_total``
    true, null group) in one ``rollup``. The rollup runs on the raw column, so by
    assignee the null group and a person named NON_ASSEGNATO stay two rows."""
    if group_by not in GROUPS:
        raise ValueError(f"invalid grouping: {group_by!r}")
    kind = GROUPS[group_by]
    df = in_period(task, "created_at", *period(start, end, as_of))
    out = df.rollup(kind).agg(F.count(F.lit(1)).alias("total"), F.grouping(kind).alias("_g"))
    total = F.col("_g") == 1
    label = F.coalesce(F.col(kind), F.lit(S.UNASSIGNED)) if kind == "assignee" else F.col(kind)
    return out.select(F.when(~total, label).alias("group_name"), F.col("total").cast("bigint").alias("total"),
                      total.alias("is_total"))


# Field names of a task in the JSON answer, in order.
JSON_FIELDS = (("id", "task_id"), ("titolo", "title"), ("descrizione", "description"), ("priorita", "priority"),
               ("stato", "status"), ("data_scadenza", "due_date"), ("giorni_alla_scadenza", "days_left"),
               ("assegnatario", "assignee"), ("task_ricorrente", "recurring"), ("frequenza_ricorrenza", "frequency"),
               ("creato_da", "created_by"), ("data_creazione", "created_at"), ("ultima_modifica", "updated_at"))


def task_list_json(listed: DataFrame) -> DataFrame:
    """One JSON document per task (``task_id``, ``json``): nulls written, dates and
    timestamps as ISO text, ``alert`` only when there is one."""
    edge = {"due_date": X.iso_date, "created_at": X.iso_timestamp, "updated_at": X.iso_timestamp}
    fields = [edge.get(c, F.col)(F.col(c) if c in edge else c).alias(k) for k, c in JSON_FIELDS]
    opts = {"ignoreNullFields": "false"}
    plain = F.to_json(F.struct(*fields), opts)
    alerted = F.to_json(F.struct(*fields, F.col("alert")), opts)
    return listed.select("task_id", F.when(F.col("alert").isNull(), plain).otherwise(alerted).alias("json"))
