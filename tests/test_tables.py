import datetime as dt
import os
import tempfile

from larder.operators import stock
from larder.sources import tables


def test_round_trip_and_partitioned_facts(spark, inventory, consumption):
    root = tempfile.mkdtemp(prefix="larder-tables-")
    tables.write_snapshot(inventory, root, "inventory", "1")
    tables.append_facts(consumption, root, "consumption")
    days = sorted(d for d in os.listdir(f"{root}/consumption") if d.startswith("day="))
    assert days[0] == "day=2024-01-01" and len(days) == 5
    inv = tables.read(spark, root, "inventory", "1")
    assert inv.count() == 9
    assert [(f.name, f.dataType) for f in inv.schema] == [(f.name, f.dataType) for f in inventory.schema]
    facts = tables.read(spark, root, "consumption")
    assert facts.filter(facts.consumed_at >= dt.datetime(2024, 1, 10)).count() == 2
    out = f"{root}/stock_json"
    tables.write_json_lines(stock.stock_list_json(stock.list_stock(inventory, dt.date(2024, 1, 15), limit=None)), out)
    lines = spark.read.text(out).collect()
    assert len(lines) == 8 and all(line.value.startswith('{"id":') for line in lines)


def test_snapshot_files_sorted_by_key_and_lookup_pushed(spark, inventory):
    from pyspark.sql import functions as F
    root = tempfile.mkdtemp(prefix="larder-tables-")
    tables.write_snapshot(inventory.repartition(3), root, "inventory", "1")
    inv = tables.read(spark, root, "inventory", "1")
    per_file = inv.select(F.input_file_name().alias("f"), "item_id").collect()
    files = {}
    for r in per_file:
        files.setdefault(r.f, []).append(r.item_id)
    assert all(ids == sorted(ids) for ids in files.values())
    plan = inv.filter(F.col("item_id") == 4)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(item_id,4)" in plan


def test_fact_files_sorted_by_item_within_day(spark, consumption):
    from pyspark.sql import functions as F
    root = tempfile.mkdtemp(prefix="larder-tables-")
    tables.append_facts(consumption.repartition(2), root, "consumption")
    rows = tables.read(spark, root, "consumption").select(F.input_file_name().alias("f"), "item_id").collect()
    files = {}
    for r in rows:
        files.setdefault(r.f, []).append(r.item_id)
    assert len(files) >= 5 and all(ids == sorted(ids) for ids in files.values())


def test_reading_facts_leaves_the_shared_schema_alone(spark, consumption):
    from larder import schemas as S
    root = tempfile.mkdtemp(prefix="larder-tables-")
    tables.append_facts(consumption, root, "consumption")
    before = S.TABLES["consumption"].fieldNames()
    tables.read(spark, root, "consumption").count()
    assert S.TABLES["consumption"].fieldNames() == before and "day" not in before
