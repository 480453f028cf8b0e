import datetime as dt
import json

from larder import schemas as S
from larder.operators import commands as W

NOW = dt.datetime(2024, 1, 15, 10, 0)


def test_insert_items_rejects_and_accepts(spark, inventory):
    base = dict(name="X", quantity="1", unit="KG", category="FRUTTA", location="FRIGO",
                expiry_date=None, opened_date=None, price=None, supplier=None, lot=None)
    cases = [
        ({"name": None}, "MISSING_FIELD"),
        ({"unit": "LITRO"}, "INVALID_UNIT"),
        ({"quantity": "0"}, "NON_POSITIVE_QUANTITY"),
        ({"quantity": "12345678.9"}, "QUANTITY_OUT_OF_RANGE"),
        ({"expiry_date": "2024-02-30"}, "INVALID_EXPIRY_DATE"),
        ({"opened_date": "2024-01-16"}, "OPENED_IN_FUTURE"),
        ({"name": "n" * 256}, "NAME_TOO_LONG"),
        ({"expiry_date": "2024-1-5"}, "OK"),
        ({"price": "0"}, "OK"),
    ]
    rows = []
    for i, (over, _) in enumerate(cases, start=1):
        r = dict(base, **over)
        rows.append((i, "tester", r["name"], r["quantity"], r["unit"], r["category"], r["location"],
                     r["expiry_date"], r["opened_date"], r["price"], r["supplier"], r["lot"]))
    res = W.insert_items(inventory, spark.createDataFrame(rows, S.INSERT_ITEM_CMD), NOW)
    got = {r.seq: r.code for r in res.outcomes.collect()}
    assert [got[i] for i in range(1, len(cases) + 1)] == [c for _, c in cases]
    added = {r.item_id: r for r in res.added.collect()}
    assert set(added) == {9 + 8, 9 + 9}  # max id 9 + seq
    assert added[17].expiry_date == dt.date(2024, 1, 5)
    assert added[18].price is None
    audit = res.audit.collect()
    assert len(audit) == 2 and json.loads(audit[0].details)["quantita"] == 1.0
    assert res.table.count() == 11


def test_update_items_last_non_null_wins(spark, inventory):
    rows = [
        (1, "a", 1, None, "0", None, None, None, None, None, None, None),
        (2, "b", 1, None, None, None, None, None, None, "3.00", None, None),
        (3, "c", 1, None, None, None, None, None, None, None, None, None),
        (4, "d", 99, "X", None, None, None, None, None, None, None, None),
    ]
    res = W.update_items(inventory, spark.createDataFrame(rows, S.UPDATE_ITEM_CMD), NOW)
    codes = {r.seq: r.code for r in res.outcomes.collect()}
    assert codes == {1: "OK", 2: "OK", 3: "NOTHING_TO_UPDATE", 4: "NOT_FOUND"}
    item = [r for r in res.table.collect() if r.item_id == 1][0]
    assert float(item.quantity) == 0.0 and float(item.price) == 3.0 and item.name == "Latte Intero"
    assert item.updated_by == "b" and item.updated_at == NOW
    untouched = [r for r in res.table.collect() if r.item_id == 2][0]
    assert untouched.updated_by == "system"
    assert json.loads(res.audit.filter("seq = 2").collect()[0].details) == {"prezzo_acquisto": 3.0}


def test_complete_tasks_first_wins_and_respawn(spark, tasks):
    calls = [(1, "u", 5, None), (2, "u", 6, "ok"), (3, "u", 4, None), (4, "u", 5, None), (5, "u", 99, None),
             (6, "u", 1, None)]
    res = W.complete_tasks(tasks, spark.createDataFrame(calls, S.COMPLETE_TASK_CMD), NOW)
    codes = [r.code for r in res.outcomes.orderBy("seq").collect()]
    assert codes == ["OK", "OK", "ALREADY_COMPLETED", "ALREADY_COMPLETED", "NOT_FOUND", "OK"]
    spawned = {r.parent_task_id: r for r in res.added.collect()}
    assert set(spawned) == {5, 6}
    assert spawned[5].due_date == dt.date(2024, 3, 1) and spawned[6].due_date is None
    assert all(r.status == "DA_FARE" and r.recurring for r in spawned.values())
    status = {r.task_id: r.status for r in res.table.collect()}
    assert status[5] == status[6] == status[1] == "COMPLETATO" and status[2] == "DA_FARE"
    det = {r.record_id: json.loads(r.details) for r in res.audit.collect()}
    assert det[5]["nuovo_task_id"] == 7 + 1 and det[1] == {"note_completamento": None, "ricorrente": False,
                                                         "nuovo_task_id": None}


def test_cancel_is_repeatable(spark, tasks):
    calls = [(1, "u", 4, "dup"), (2, "u", 4, None), (3, "u", 42, None)]
    res = W.cancel_tasks(tasks, spark.createDataFrame(calls, S.CANCEL_TASK_CMD), NOW)
    assert [r.code for r in res.outcomes.orderBy("seq").collect()] == ["OK", "OK", "NOT_FOUND"]
    assert [r.status for r in res.table.filter("task_id = 4").collect()] == ["ANNULLATO"]


def test_insert_tasks(spark, tasks):
    rows = [(1, "u", "T", None, None, None, None, True, None),
            (2, "u", "T", None, None, "2024-1-5", None, False, "MENSILE"),
            (3, "u", "", None, None, None, None, None, None)]
    res = W.insert_tasks(tasks, spark.createDataFrame(rows, S.INSERT_TASK_CMD), NOW)
    assert [r.code for r in res.outcomes.orderBy("seq").collect()] == ["MISSING_FREQUENCY", "OK", "MISSING_TITLE"]
    r = res.added.collect()[0]
    assert r.priority == "MEDIA" and r.frequency is None and r.due_date == dt.date(2024, 1, 5)
