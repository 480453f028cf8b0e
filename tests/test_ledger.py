import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder import schemas as S
from larder.functions.running import numbered, running_sum
from larder.operators import ledger as L

NOW = dt.datetime(2024, 1, 15, 10, 0)


def inv_one(spark, qty="10.000"):
    created = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(1, "Item", Decimal(qty), "KG", None, None, "FRUTTA", "FRIGO", None, None,
                                   None, created, created, "system")], S.INVENTORY)


def test_fixture_ledger(spark):
    cmds = spark.createDataFrame([
        (1, "a", 1, Decimal("4"), None, None, False),
        (2, "a", 1, Decimal("7"), None, None, False),
        (3, "a", 1, Decimal("6"), None, None, False),
        (4, "b", 1, Decimal("1"), None, None, True),
    ], S.CONSUME_CMD)
    res = L.consume(inv_one(spark), cmds, NOW)
    got = [(r.ok, r.code, float(r.balance_before), float(r.balance_after))
           for r in res.outcomes.orderBy("seq").collect()]
    assert got == [(True, "OK", 10, 6), (False, "INSUFFICIENT", 6, 6), (True, "EXHAUSTED", 6, 0),
                   (True, "EXHAUSTED", 0, 0)]
    facts = res.facts.orderBy("consumption_id").collect()
    assert [float(f.qty) for f in facts] == [4, 6, 1]
    assert res.audit.count() == 3
    t = res.table.collect()[0]
    assert float(t.quantity) == 0 and t.updated_by == "b"


def brute(opening, reqs):
    """Plain Python fold over (qty thousandths, force, valid) in order."""
    out, b = [], opening
    for q, f in reqs:
        if q > b and not f:
            out.append((False, b, b))
        else:
            n = max(0, b - q)
            out.append((True, b, n))
            b = n
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.booleans()), min_size=1, max_size=40),
       st.integers(0, 60))
def test_fold_matches_brute_force(spark, reqs, opening):
    rows = [(i + 1, "u", 1, Decimal(q), None, None, f) for i, (q, f) in enumerate(reqs)]
    res = L.consume(inv_one(spark, f"{opening}.000"), spark.createDataFrame(rows, S.CONSUME_CMD), NOW)
    got = [(r.ok, int(r.balance_before), int(r.balance_after)) for r in res.outcomes.orderBy("seq").collect()]
    want = [(ok, b // 1000, a // 1000) for ok, b, a in brute(opening * 1000, [(q * 1000, f) for q, f in reqs])]
    assert got == want
    assert all(a >= 0 for _, _, a in got)


def fold(stock, calls):
    """The ledger as a plain loop over calls (item, thousandths, force, reason valid) in
    order: (code, before, after) of each."""
    opening = {}
    for item, k in stock:
        k = max(0, k or 0)
        opening[item] = min(k, opening.get(item, k))
    out = []
    for item, q, force, valid in calls:
        b = opening.get(item)
        after = b
        if not item or not q:
            code = "MISSING_FIELD"
        elif q < 0:
            code = "NON_POSITIVE_QUANTITY"
        elif b is None:
            code = "NOT_FOUND"
        elif q > b and not force:
            code = "INSUFFICIENT"
        elif not valid:
            code = "INVALID_REASON"
        else:
            after = opening[item] = max(0, b - q)
            code = "EXHAUSTED" if after == 0 else "OK"
        out.append((code, b, after))
    return out


def unclean_stock(rnd, items):
    """Stock rows (item, thousandths) with null, negative and duplicate entries."""
    rows = [(i, rnd.choice([None, -5000, 0, rnd.randint(1, 90_000), rnd.randint(1, 9_000_000)])) for i in items]
    return rows + [(i, rnd.randint(0, 50_000)) for i in items[::3]]


def stock_frame(spark, rows):
    created = dt.datetime(2024, 1, 1)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in S.INVENTORY.fields])
    return spark.createDataFrame([(i, f"I{i}", None if k is None else Decimal(k) / 1000, "KG", None, None, "FRUTTA", "FRIGO", None,
                                   None, None, created, created, "system") for i, k in rows], schema)


def outcome_tuples(df):
    k = lambda x: None if x is None else int(x * 1000)
    return {r.seq: (r.code, k(r.balance_before), k(r.balance_after)) for r in df.collect()}


def random_calls(rnd, n, items, hot=None):
    calls = []
    for _ in range(n):
        item = hot if hot and rnd.random() < 0.4 else rnd.choice(items + [0, 999])
        calls.append((item, rnd.choice([0, -1000] + [rnd.randint(1, 20_000)] * 20), rnd.random() < 0.1, rnd.random() < 0.9))
    return calls


def call_frame(spark, calls):
    return spark.createDataFrame([(s, "u", i, Decimal(q) / 1000, None if ok else "PERSO", None, f)
                                  for s, (i, q, f, ok) in enumerate(calls, 1)], S.CONSUME_CMD)


@pytest.mark.parametrize("rows_per_task", [L.ROWS_PER_TASK, 100, 0])
def test_levels_equal_the_fold_on_unclean_stock(spark, rows_per_task):
    """The same answer whether an item is settled in one task or by scans over chunks."""
    rnd = random.Random(17)
    items = list(range(1, 12))
    stock, calls = unclean_stock(rnd, items), random_calls(rnd, 1500, items, hot=4)
    inv, cmds = stock_frame(spark, stock), call_frame(spark, calls)
    want = dict(enumerate(fold(stock, calls), 1))
    assert outcome_tuples(L.consume(inv, cmds, NOW, rows_per_task=rows_per_task).outcomes) == want
    forced = [(i, q, True, ok) for i, q, _, ok in calls]
    want = dict(enumerate(fold(stock, forced), 1))
    assert outcome_tuples(L.consume(inv, call_frame(spark, forced), NOW, rows_per_task=rows_per_task).outcomes) == want
    assert outcome_tuples(L.consume_forced(inv, cmds, NOW)) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=4),
       st.lists(st.tuples(st.integers(0, 3), st.integers(1, 60), st.booleans(), st.booleans()), max_size=60))
def test_settle_equals_the_fold(opening, calls):
    calls = sorted((c for c in calls if c[0] < len(opening)), key=lambda c: c[0])
    seg, q, force, valid = (np.array([c[k] for c in calls], t) for k, t in enumerate((np.int64, np.int64, bool, bool)))
    before, after = L.settle(seg, np.array(opening, np.int64), q, force, valid)
    want = fold(list(enumerate(opening, 1)), [(i + 1, x, f, v) for i, x, f, v in calls])
    assert list(zip(before.tolist(), after.tolist())) == [(b, a) for _, b, a in want]


def test_hot_item_is_spread_over_tasks(spark):
    """One item holds a third of all rows, none forced: the chunks that its levels scan
    hold no more than their share, and the answer is the fold's."""
    rnd = random.Random(3)
    calls = [(1 if s % 3 == 0 else 2 + s, rnd.randint(1, 900), False, True) for s in range(12_000)]
    stock = [(1, 1_000_000)] + [(2 + s, 500) for s in range(0, 12_000, 2)]
    inv, cmds = stock_frame(spark, stock), call_frame(spark, calls)
    checked = L.check_requests(cmds, ("seq",), discard=False).filter("item_id = 1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # it would merge chunks as small as these
    try:
        placed = checked.repartitionByRange("item_id", "seq").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r[1] for r in placed) <= 2 * 4000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = outcome_tuples(L.consume(inv, cmds, NOW, rows_per_task=1000).outcomes)
    assert got == dict(enumerate(fold(stock, calls), 1))


@pytest.mark.parametrize("forced", [False, True])
def test_only_items_across_chunks_take_further_passes(spark, monkeypatch, forced):
    """Chunked requests are moved and written once; rows are written again only for items
    that go on into a further chunk, here a known and an unknown hot one."""
    rnd = random.Random(23)
    calls = [(rnd.choice([7, 5000] + list(range(1, 400)) * 2) if s % 4 else rnd.choice([7, 5000]), rnd.choice([0] + [rnd.randint(1, 900)] * 9),
              forced or rnd.random() < 0.1, rnd.random() < 0.95) for s in range(4000)]
    stock = [(i, 60_000 if i == 7 else rnd.randint(0, 4000)) for i in range(1, 400)]
    inv, cmds = stock_frame(spark, stock), call_frame(spark, calls)
    written, real = {}, L.stored

    def counted(df, name):
        out = real(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(L, "stored", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # it would merge chunks as small as these
    try:
        got = outcome_tuples(L.consume(inv, cmds, NOW, rows_per_task=0).outcomes)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == dict(enumerate(fold(stock, calls), 1))
    hot = sum(1 for c in calls if c[0] in (7, 5000))
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(sum(1 for c in calls if c[0] == i) for i in range(1, 400) if i != 7)
    assert written["ledger-placed"] == [4000]
    assert 0 < written["ledger-level"][0] <= hot + chunks * most < 2000


@pytest.mark.parametrize("forced", [False, True])
def test_settled_requests_stay_where_they_are(spark, monkeypatch, forced):
    """The items that go on into a further chunk, one per chunk at most, are sent to the
    settled requests: these, however many, are not shuffled to meet them."""
    rnd = random.Random(29)
    calls = [(rnd.choice([7, *range(1, 400)]) if s % 4 else 7, rnd.randint(1, 900), forced or rnd.random() < 0.1, rnd.random() < 0.95) for s in range(12_000)]
    stock = [(i, 60_000 if i == 7 else rnd.randint(0, 4000)) for i in range(1, 400)]
    plans, items, real = [], [], L.stored

    def watched(df, name):
        if name == "ledger-level":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = real(df, name)
        if name == "ledger-going-on":
            items.append(out.count())
        return out

    monkeypatch.setattr(L, "stored", watched)
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "12k"}
    old = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        got = outcome_tuples(L.consume(stock_frame(spark, stock), call_frame(spark, calls), NOW, rows_per_task=0).outcomes)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == dict(enumerate(fold(stock, calls), 1))
    semi = [line for line in plans[0].splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)
    assert 0 < items[0] <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_carry_over_arrow_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rnd = random.Random(9)
        stock, calls = unclean_stock(rnd, [1, 2, 3]), random_calls(rnd, 300, [1, 2, 3])
        got = outcome_tuples(L.consume(stock_frame(spark, stock), call_frame(spark, calls), NOW).outcomes)
        assert got == dict(enumerate(fold(stock, calls), 1))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_facts_and_audit_need_call_numbers(spark):
    cmds = call_frame(spark, [(1, 4000, False, True), (1, 7000, False, True), (None, 1000, False, True)])
    without = L.consume(inv_one(spark), cmds, NOW, order_cols=("qty",)).outcomes.drop("seq")
    assert without.count() == 3
    res = L.consume(inv_one(spark), cmds.drop("seq"), NOW, order_cols=("qty",))
    for frame in ("facts", "audit"):
        with pytest.raises(ValueError):
            getattr(res, frame)


def test_properties_on_random_batch(spark):
    rnd = random.Random(11)
    created = dt.datetime(2024, 1, 1)
    inv = spark.createDataFrame([(i, f"I{i}", Decimal(rnd.randint(0, 30)), "KG", None, None, "FRUTTA", "FRIGO",
                                  None, None, None, created, created, "system") for i in range(1, 11)], S.INVENTORY)
    rows = [(s, "u", rnd.randint(0, 12), Decimal(rnd.randint(-1, 9)), rnd.choice([None, "SCADUTO", "PERSO"]), None,
             rnd.random() < 0.2) for s in range(1, 301)]
    res = L.consume(inv, spark.createDataFrame(rows, S.CONSUME_CMD), NOW)
    out = res.outcomes.collect()
    assert len(out) == 300
    assert all(r.balance_after is None or r.balance_after >= 0 for r in out)
    assert res.audit.count() == sum(1 for r in out if r.ok) == res.facts.count()
    bal = {r.item_id: r for r in L.ledger_balances(res.outcomes).collect()}
    assert sum(b.accepted + b.rejected for b in bal.values()) == 300
    codes = {r.code for r in out}
    assert {"NOT_FOUND", "NON_POSITIVE_QUANTITY", "MISSING_FIELD", "INVALID_REASON"} <= codes


def test_discard_refuses_other_reasons(spark):
    cmds = spark.createDataFrame([(1, "a", 1, Decimal("1"), "CONSUMATO", None),
                                  (2, "a", 1, Decimal("1"), "BUTTATO", None)], S.DISCARD_CMD)
    out = L.discard(inv_one(spark), cmds, NOW).outcomes.orderBy("seq").collect()
    assert [r.code for r in out] == ["INVALID_REASON", "OK"]
    assert [r.effective_reason for r in out] == ["CONSUMATO", "BUTTATO"]


def test_running_sum_of_a_hot_key(spark):
    """Sums are right where one key covers many chunks and where keys share a chunk."""
    rnd = random.Random(3)
    rows = [(1 if rnd.random() < 0.6 else rnd.randint(2, 40), s, rnd.randint(-5, 9)) for s in range(3000)]
    df = spark.createDataFrame(rows, "k long, s long, v long").repartition(7)
    out = running_sum(df, ["k"], ["s"], "total", F.col("v")).collect()
    want, sums = {}, {}
    for k, s, v in rows:
        want[s] = sums[k] = sums.get(k, 0) + v
    assert {r.s: r.total for r in out} == want


def test_numbered_calls_are_ranked(spark):
    rows = [(random.Random(s).randint(1, 500), s) for s in range(2000)]
    out = numbered(spark.createDataFrame(rows, "a long, b long").repartition(5), ("a", "b")).collect()
    assert [(r.a, r.b) for r in sorted(out, key=lambda r: r.seq)] == sorted(rows)
    assert sorted(r.seq for r in out) == list(range(1, 2001))


def test_lineitem_ties_are_ordered_by_reason(spark):
    """Two calls equal in every other order column but with different reasons: a
    discard refuses one of them, so their order decides the balances reported.
    The reason ends the order, so every partitioning gives the same outcomes."""
    from larder.sources import adapters as A
    from larder.plans.catalog import discard_commands
    inv = inv_one(spark, "5.000")
    row = (7, 1, 3, 1, Decimal("2"), Decimal("1.00"), None, dt.date(1996, 3, 1))
    rows = [row[:6] + ("A",) + row[7:], row[:6] + ("R",) + row[7:], row[:6] + ("N",) + row[7:]]
    li = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                                     "l_quantity decimal(15,2), l_extendedprice decimal(15,2), "
                                     "l_returnflag string, l_shipdate date")
    seen = set()
    for parts, rev in ((1, False), (3, False), (3, True)):
        src = li.orderBy(li.l_returnflag.desc() if rev else li.l_returnflag).repartition(parts)
        out = L.discard(inv, discard_commands(src), NOW, A.LINEITEM_LEDGER_ORDER).outcomes
        seen.add(tuple(sorted((r.effective_reason, r.code, str(r.balance_before), str(r.balance_after))
                              for r in out.collect())))
    assert len(seen) == 1
    # BUTTATO (R) sorts first and is accepted, CONSUMATO (A) is refused, SCADUTO (N) takes two more
    assert sorted(seen.pop()) == sorted([("BUTTATO", "OK", "5.000", "3.000"),
                                         ("CONSUMATO", "INVALID_REASON", "3.000", "3.000"),
                                         ("SCADUTO", "OK", "3.000", "1.000")])
