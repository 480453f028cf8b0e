"""Plan shape: the physical plans the scale design relies on (pushdown, pruning,
map-side aggregation, top-k without a sort, size-checked broadcasts only, no
row-at-a-time Python, one shuffle for the ledger fold)."""

import os
import re

import pytest

import __spark_entry__ as E
from larder.plans import catalog

SMOKE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables absent")

BATCH = sorted(n for n in catalog.QUERIES if not n.startswith("stream"))


def plan(spark, name):
    return E.queries()[name](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()


def scans(p, table):
    return [ln for ln in p.splitlines() if "FileScan parquet" in ln and f"/{table}.parquet" in ln]


@pytest.mark.parametrize("name", BATCH)
def test_no_hints_python_rows_or_pairs(spark, name):
    q = E.queries()[name](spark, SMOKE)._jdf.queryExecution()
    p = q.executedPlan().toString()
    assert "ResolvedHint" not in q.analyzed().toString()
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_broadcasts_are_size_decisions(spark):
    """With the size threshold off, no plan broadcasts anything."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in BATCH:
            assert "BroadcastExchange" not in plan(spark, name), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["stock_list", "task_list", "item_search"])
def test_top_k_without_shuffle(spark, name):
    p = plan(spark, name)
    assert p.startswith("TakeOrderedAndProject")
    assert "Exchange" not in p and "Sort [" not in p


def test_only_reports_limit(spark):
    """Row limits appear only in the top-k reports."""
    for name in BATCH:
        p = plan(spark, name)
        if name not in ("stock_list", "task_list", "item_search", "item_search_indexed", "item_search_empty"):
            assert not re.search(r"TakeOrderedAndProject|GlobalLimit|LocalLimit|CollectLimit", p), name


def test_consumption_period_pushed_and_aggregated_before_join(spark):
    p = plan(spark, "consumption_by_category")
    (scan,) = scans(p, "lineitem")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", scan)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(l_shipdate", scan)
    assert re.search(r"ReadSchema: struct<l_partkey:[^,]+,l_quantity:[^,]+,l_shipdate:[^,>]+>", scan)
    lines = p.splitlines()
    join = next(i for i, ln in enumerate(lines) if "Join" in ln)
    below = "\n".join(lines[join:])
    assert "partial_sum(qty" in below and "partial_count(1)" in below


def test_ledger_shuffles_requests_once(spark):
    """One shuffle of the requests by item (the other one is the opening balances')."""
    p = plan(spark, "consume_outcomes")
    exchanges = re.findall(r"Exchange (\w+)\(([^,)]*)", p)
    assert len(exchanges) == 2 and all(kind == "hashpartitioning" and by.startswith("item_id") for kind, by in exchanges)
    assert "MapInArrow" in p


def test_forced_ledger_is_a_scan_in_the_engine(spark):
    """Two levels of sums over chunks of the call order: no Python, no level by level."""
    p = plan(spark, "consume_forced")
    assert "MapInArrow" not in p and "Python" not in p
    assert p.count("Window [") == 2 and "SinglePartition" not in p


@pytest.mark.parametrize("job", ["item_update", "task_complete", "task_cancel"])
def test_hot_key_of_calls_is_split(spark, job):
    """Six calls in ten name one key: the lookup of the key splits that partition."""
    import datetime as dt
    from decimal import Decimal  # noqa: F401

    from pyspark.sql import functions as F

    from larder.operators import commands as W
    from larder.sources import adapters as A
    now = dt.datetime(2024, 1, 15)
    seq = spark.range(1, 60001, numPartitions=8)
    key = F.when(F.col("id") % 10 < 6, F.lit(7)).otherwise(F.col("id") % 1000 + 1)
    actor = F.concat(F.lit("u"), F.col("id").cast("string"))
    if job == "item_update":
        text = F.repeat(F.lit("x"), 60)
        calls = seq.select(F.col("id").alias("seq"), actor.alias("actor"), key.alias("item_id"), text.alias("name"),
                           *[F.lit(None).cast("string").alias(c) for c in ("quantity", "expiry_date", "opened_date", "category",
                                                                            "location", "price", "supplier", "lot")])
        run = lambda: W.update_items(A.load(spark, SMOKE)["inventory"], calls, now).outcomes
    else:
        calls = seq.select(F.col("id").alias("seq"), actor.alias("actor"), key.alias("task_id"), F.repeat(F.lit("n"), 60).alias("note"),
                           F.lit("r").alias("reason"))
        fn = W.complete_tasks if job == "task_complete" else W.cancel_tasks
        run = lambda: fn(A.load(spark, SMOKE)["task"], calls, now).outcomes
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = run()
        assert df.count() == 60000
        out = run()
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        p = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in p, p[:3000]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_column_pruning_on_lookups(spark):
    """The existence lookup of the update job reads only the key of the inventory."""
    p = plan(spark, "item_update_outcomes")
    assert any(re.search(r"ReadSchema: struct<p_partkey:bigint>", s) for s in scans(p, "part"))


def test_single_partition_only_after_partial_aggregate(spark):
    """A global exchange only ever receives one partial row per task (scalar
    aggregates such as ``max(id)`` or KPI totals) or one count per range of the call
    order (``numbered``), never the rows themselves."""
    for name in BATCH:
        lines = plan(spark, name).splitlines()
        for i, ln in enumerate(lines):
            if "Exchange SinglePartition" in ln:
                assert re.search(r"HashAggregate\(keys=(\[\], functions=\[partial_|\[_chunk#\d+\], functions=\[min\(_pos)", lines[i + 1]), (name, lines[i + 1])
