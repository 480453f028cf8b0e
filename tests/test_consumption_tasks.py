import datetime as dt

import pytest
from conftest import AS_OF

from larder.operators import consumption as C
from larder.operators import tasks as T

START, END = dt.date(2024, 1, 1), dt.date(2024, 1, 10)


def table(df):
    return [(r.group_name, float(r.total_qty), r.operations, float(r.daily_mean)) for r in df.collect()]


def test_by_category(consumption, inventory):
    assert table(C.consumption_stats(consumption, inventory, START, END, "categoria")) == [
        ("LATTICINI", 2.75, 3, 0.275), ("CARNE", 1.0, 1, 0.1)]


def test_by_reason(consumption, inventory):
    assert table(C.consumption_stats(consumption, inventory, START, END, "motivo")) == [
        ("BUTTATO", 2.0, 1, 0.2), ("SCADUTO", 1.0, 1, 0.1), ("CONSUMATO", 0.75, 2, 0.075)]


def test_total_and_empty_period(consumption, inventory):
    assert table(C.consumption_stats(consumption, inventory, START, END, "totale")) == [("TOTALE", 3.75, 4, 0.375)]
    assert C.consumption_stats(consumption, inventory, dt.date(2023, 1, 1), dt.date(2023, 12, 31)).count() == 0
    assert table(C.consumption_stats(consumption, inventory, dt.date(2023, 1, 1), dt.date(2023, 12, 31),
                                     "totale")) == [("TOTALE", 0.0, 0, 0.0)]


def test_unknown_grouping_raises(consumption, inventory):
    with pytest.raises(ValueError):
        C.consumption_stats(consumption, inventory, START, END, "fornitore")


def test_rollup(consumption, inventory):
    rows = {r.group_name: (float(r.total_qty), r.operations, r.is_total)
            for r in C.consumption_rollup(consumption, inventory, START, END).collect()}
    assert rows[None] == (3.75, 4, True) and rows["CARNE"] == (1.0, 1, False)


def test_task_list_order(tasks):
    assert [r.task_id for r in T.list_tasks(tasks, AS_OF).collect()] == [4, 2, 3, 7, 1, 5, 6]


def test_task_alerts(tasks):
    got = {r.task_id: r.alert for r in T.list_tasks(tasks, AS_OF).collect()}
    assert got[4] == "SCADUTO"
    assert all(got[i] == "SCADENZA_IMMINENTE" for i in (2, 3, 7, 1))
    assert got[5] is None and got[6] is None


def test_recurring_false_filters(tasks):
    assert [r.task_id for r in T.list_tasks(tasks, AS_OF, recurring=False).collect()] == [2, 3, 7, 1]


def test_stats_by_assignee_keeps_two_unassigned_rows(tasks):
    rows = sorted((r.group_name, r.total) for r in
                  T.task_stats(tasks, dt.date(2024, 1, 1), dt.date(2024, 1, 31), "assegnatario").collect())
    assert rows == [("NON_ASSEGNATO", 1), ("NON_ASSEGNATO", 2), ("anna", 3), ("luca", 1)]


def test_done_last_week(tasks):
    assert T.tasks_done_last_week(tasks, dt.datetime(2024, 1, 8)).collect()[0].completed == 1
    assert T.tasks_done_last_week(tasks, dt.datetime(2024, 1, 20)).collect()[0].completed == 0


def test_stats_rollup_keeps_label_collisions_apart(tasks):
    rows = sorted(((r.group_name or ""), r.total, r.is_total) for r in
                  T.task_stats_rollup(tasks, dt.date(2024, 1, 1), dt.date(2024, 1, 31), "assegnatario").collect())
    assert rows == [("", 7, True), ("NON_ASSEGNATO", 1, False), ("NON_ASSEGNATO", 2, False), ("anna", 3, False),
                    ("luca", 1, False)]
