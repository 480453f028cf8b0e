"""Stored tables: buckets of entity tables, lookups by key, day sums, deletes, and the
search through postings."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder import schemas as S
from larder.operators import commands as W
from larder.operators import consumption as C
from larder.operators import day_sums, deletes, quality, search_index, stock
from larder.session import scratch_path
from larder.sources import bucketed, tables
from larder.sources.numbers import BITS, small_numbers

NOW = dt.datetime(2024, 1, 15, 10)


def items(spark, n, name=lambda i: f"Item {i}"):
    created = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, name(i), Decimal(i % 7), "KG", None, None, "FRUTTA" if i % 2 else "CARNE", "FRIGO", None, None, None,
                                   created, created, "system") for i in range(1, n + 1)], S.INVENTORY)


def local(path):
    return path.removeprefix("file:")


def files(path):
    """Each folder's data files."""
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in sorted(os.listdir(path)) if "=" in d}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def calls(spark, *changes):
    base = {f.name: None for f in S.UPDATE_ITEM_CMD.fields}
    return spark.createDataFrame([tuple({**base, **c}[f.name] for f in S.UPDATE_ITEM_CMD.fields) for c in changes], S.UPDATE_ITEM_CMD)


def test_small_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (0, 5, 5, None, 8, 32767, 1)], "x long")
    assert small_numbers(df, "x") == [0, 1, 5, 8, 32767]
    assert small_numbers(df.filter("x < 0"), "x") == []
    with pytest.raises(ValueError):
        small_numbers(spark.createDataFrame([(BITS,)], "x long"), "x")
    with pytest.raises(ValueError):
        small_numbers(spark.createDataFrame([(-1,), (2,)], "x long"), "x")


def test_an_update_rewrites_the_buckets_of_changed_items(spark):
    root = local(scratch_path(spark, "test-buckets"))
    inv = items(spark, 400)
    bucketed.write(inv, root, "inventory", buckets=8)
    before = files(f"{root}/inventory")
    assert len(before) == 8
    batch = calls(spark, {"seq": 1, "actor": "anna", "item_id": 17, "name": "New"}, {"seq": 2, "item_id": 100000, "name": "x"},
                  {"seq": 3, "item_id": None, "name": "x"}, {"seq": 4, "item_id": 18, "quantity": "-1"})
    job = lambda table, some: W.update_items(table, some, NOW, store=True)
    result = bucketed.apply_changes(spark, root, "inventory", batch, job, buckets=8)
    assert {r.seq: r.code for r in result.outcomes.collect()} == {1: "OK", 2: "NOT_FOUND", 3: "MISSING_ID", 4: "QUANTITY_NEGATIVE"}
    after = files(f"{root}/inventory")
    changed = [d for d in before if before[d] != after[d]]
    home = inv.filter("item_id = 17").select(bucketed.bucket_of(F.col("item_id"), 8)).first()[0]
    assert changed == [f"bucket={home}"]
    want = W.update_items(inv, batch, NOW).table
    assert rows(bucketed.read(spark, root, "inventory").drop("bucket")) == rows(want.select(*S.INVENTORY.fieldNames()))
    bucketed.apply_changes(spark, root, "inventory", batch, job, buckets=8)   # the same calls again, as after a crash
    assert rows(bucketed.read(spark, root, "inventory").drop("bucket")) == rows(want.select(*S.INVENTORY.fieldNames()))
    refused = files(f"{root}/inventory")
    bucketed.apply_changes(spark, root, "inventory", calls(spark, {"seq": 1, "item_id": 99999, "name": "x"}), job, buckets=8)
    assert files(f"{root}/inventory") == refused


def test_a_lookup_reads_few_row_groups(spark):
    root = scratch_path(spark, "test-lookup")
    n = 40000
    inv = spark.range(1, n + 1).select(
        F.col("id").alias("item_id"), F.concat(F.lit("Item "), F.col("id").cast("string")).alias("name"), F.lit(1).cast(S.QTY).alias("quantity"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in S.INVENTORY.fields if f.name not in ("item_id", "name", "quantity")])
    bucketed.write(inv, root, "inventory", buckets=4, rows_per_group=500)
    wanted = [3, 777, 20000, 39999, 123456]
    found = bucketed.lookup(spark, root, "inventory", wanted, buckets=4)
    assert sorted(r.item_id for r in found.collect()) == wanted[:4]
    plan = found._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PartitionFilters: [bucket" in text and "In(item_id" in text
    while not plan.nodeName().startswith("Scan"):
        plan = plan.children().apply(0)
    read = plan.metrics().apply("numOutputRows").value()
    # four keys of four row groups of 500 rows, and a false positive or two of the bloom filters
    assert 4 <= read <= 3000, read
    assert bucketed.lookup(spark, root, "inventory", [], buckets=4).count() == 0


def facts(spark, n=300):
    out = []
    for i in range(1, n + 1):
        day = dt.datetime(2024, 1 + i % 3, 1 + i % 20 % 7, i % 24)
        out.append((i, i % 20, Decimal(i % 5 + 1), day, ("CONSUMATO", "SCADUTO", "BUTTATO")[i % 3], None))
    # item 21 stands alone on a day; item 22 has facts without a time
    out += [(1001, 21, Decimal(2), dt.datetime(2024, 5, 5), "CONSUMATO", None), (1002, 22, Decimal(2), None, "CONSUMATO", None),
            (1003, 5, Decimal(1), None, "SCADUTO", None)]
    # a stored table may hold what the rules forbid: times are nullable here
    return spark.createDataFrame(out, T.StructType([T.StructField(f.name, f.dataType) for f in S.CONSUMPTION.fields]))


@pytest.mark.parametrize("group_by", ["categoria", "motivo", "totale"])
def test_maintained_day_sums_equal_the_direct_form(spark, group_by):
    root = scratch_path(spark, "test-days")
    inv, all_facts = items(spark, 25), facts(spark)
    first, second = all_facts.filter("consumption_id % 2 = 0"), all_facts.filter("consumption_id % 2 = 1")
    day_sums.add_facts(first, root, "1")
    day_sums.add_facts(second, root, "2")
    day_sums.add_facts(second, root, "2")   # a batch applied again
    period = (dt.date(2024, 1, 3), dt.date(2024, 3, 6))
    stats = lambda stock_table: rows(day_sums.consumption_stats(spark, root, stock_table, *period, group_by))
    assert stats(inv) == rows(C.consumption_stats(all_facts, inv, *period, group_by))
    gone = inv.filter("item_id in (3, 5, 21)").select("item_id")
    for _ in range(2):                       # and a deletion applied twice
        day_sums.take_back(spark, root, gone, "delete-1")
        left = quality.without_items(inv, gone)
        assert stats(left) == rows(C.consumption_stats(quality.without_items(all_facts, gone), left, *period, group_by))


@pytest.mark.parametrize("every", ["day", "month"])
def test_deleting_facts_rewrites_their_folders_only(spark, every):
    root = local(scratch_path(spark, "test-deletes"))
    all_facts = facts(spark)
    tables.append_facts(all_facts, root, "consumption", every=every)
    day_sums.add_facts(all_facts, root, "1")
    before = files(f"{root}/consumption")
    gone = spark.createDataFrame([(21,), (22,), (4,), (77,), (None,), (4,)], "item_id long")
    want = rows(quality.without_items(all_facts, gone.filter("item_id is not null")).select(*S.CONSUMPTION.fieldNames()))
    deletes.delete_facts(spark, root, gone, "delete-1", every=every)
    assert rows(tables.read(spark, root, "consumption")) == want
    after = files(f"{root}/consumption")
    held = {str(r.d) for r in all_facts.filter("item_id in (21, 22, 4)").select(
        tables.folder_day(F.col("consumed_at"), every).alias("d")).collect() if r.d}
    changed = {d.split("=")[1] for d in before if before[d] != after[d]}
    assert changed == held | {tables.NO_DAY}
    assert len(changed) < len(before) or every == "month"
    deletes.delete_facts(spark, root, gone, "delete-1", every=every)   # the same deletion again
    assert rows(tables.read(spark, root, "consumption")) == want
    period = (dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    inv = items(spark, 25)
    assert rows(day_sums.consumption_stats(spark, root, inv, *period, "motivo")) == rows(
        C.consumption_stats(quality.without_items(all_facts, gone.filter("item_id is not null")), inv, *period, "motivo"))
    untouched = files(f"{root}/consumption")
    deletes.delete_facts(spark, root, spark.createDataFrame([(500,)], "item_id long"), "delete-2", every=every)
    assert files(f"{root}/consumption") == untouched


def test_search_through_postings_equals_the_scan(spark):
    path = scratch_path(spark, "test-postings")
    names = ["Mozzarella", "mozzarella di bufala", "50% burro", "Crème fraîche", "İstanbul", "a\\b\\c", "x_y_z", "ab", "RING ring", "Straße", "",
             "\U0001F35D spaghetti", "aaaa", "aaa", "K\u212Aelvin"]
    inv = items(spark, 60, lambda i: names[i % len(names)])
    inv = inv.withColumn("name", F.when(F.col("item_id") == 7, None).otherwise(F.col("name")))
    search_index.write(inv, path)
    for query in ["mozz", "MOZZARELLA", "moz%bufala", "mo__arella", "50%", "50% b", "crème", "fraî", "ist", "\u0130st", "a\\b", "\\b\\", "x_y_z", "_y_", "ab",
                  "", "%", "ring r", "straße", "STRASSE", "aaa", "aaaa", "frigo", "fru%tta", "spaghetti", "\U0001F35D s", "kelvin", "kke", "nothing here"]:
        for limit in (None, 3):
            want = stock.search_items(inv, query, limit)
            assert search_index.search(spark, path, inv, query, limit).collect() == want.collect(), query
    plan = search_index.search(spark, path, inv, "mozz")._jdf.queryExecution().executedPlan().toString()
    assert "In(trigram, [moz,ozz])" in plan


def test_calls_on_a_repeated_key_have_one_outcome(spark):
    inv = items(spark, 5).unionByName(items(spark, 3))
    got = W.update_items(inv, calls(spark, {"seq": 1, "item_id": 2, "name": "x"}, {"seq": 2, "item_id": 5, "name": "y"}), NOW)
    assert rows(got.outcomes.select("seq", "code")) == [(1, "OK"), (2, "OK")]
    assert got.audit.count() == 2
    assert got.table.filter("name = 'x'").count() == 2     # every row of the id changes


def test_repeated_task_ids_complete_once(spark, tasks):
    twice = tasks.unionByName(tasks.filter("task_id = 6"))
    cmds = spark.createDataFrame([(1, "a", 6, None), (2, "b", 6, None)], "seq long, actor string, task_id long, note string")
    got = W.complete_tasks(twice, cmds, NOW)
    assert rows(got.outcomes.select("seq", "code")) == [(1, "OK"), (2, "ALREADY_COMPLETED")]
    assert got.added.count() == 1 and got.audit.count() == 1
    cancelled = W.cancel_tasks(twice, cmds.withColumn("reason", F.lit("r")), NOW)
    assert cancelled.outcomes.count() == 2 and cancelled.audit.count() == 2


def test_answer_documents(spark, inventory):
    found = stock.search_json(stock.search_items(inventory, "latt"))
    assert found.collect()[0].json == '{"id":"alimento-9","title":"Burro_50% (1.000 PEZZI)","category":"LATTICINI","location":"FRIGO"}'
    ids = spark.createDataFrame([("alimento-1",), ("alimento-99",), ("x",)], "id string")
    docs = {r.request_id: r.json for r in stock.fetch_json(stock.fetch_items(inventory, ids)).collect()}
    assert docs["x"] == docs["alimento-99"] == '{"error":"NOT_FOUND"}'
    assert docs["alimento-1"].startswith('{"id":"alimento-1","name":"Latte Intero","quantity":"2.000 LITRI"')
    assert rows(stock.search_counts(inventory, "latt", 2)) == [(3, 2)]
    assert rows(stock.search_counts(inventory, "", 2)) == [(0, 0)]
