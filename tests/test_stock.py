from conftest import AS_OF

from larder.operators import stock


def ids(df, col="item_id"):
    return [r[col] for r in df.collect()]


def test_stock_list_order_and_days(inventory):
    df = stock.list_stock(inventory, AS_OF)
    rows = df.collect()
    assert [r.item_id for r in rows] == [3, 1, 4, 9, 7, 8, 2, 5]
    assert [r.days_left for r in rows] == [-3, 0, 1, 2, 3, 4, 5, None]
    assert {r.item_id: r.price for r in rows}[4] is None  # price 0 shown as null


def test_stock_alerts(inventory):
    rows = {r.item_id: r.alert for r in stock.list_stock(inventory, AS_OF).collect()}
    assert rows[3] == "SCADUTO"
    assert [rows[i] for i in (1, 4, 9, 7)] == ["IN_SCADENZA"] * 4
    assert rows[8] is None and rows[2] is None and rows[5] is None


def test_stock_kpis(inventory):
    r = stock.stock_kpis(inventory, AS_OF).collect()[0]
    assert tuple(r) == (8, 2, 3, 6, 3)


def test_stock_kpis_empty_filter_keeps_null_sums(inventory):
    r = stock.stock_kpis(inventory, AS_OF, category="PESCE").collect()[0]
    assert tuple(r) == (0, None, None, 0, 0)


def test_zero_days_means_no_filter(inventory):
    assert stock.list_stock(inventory, AS_OF, expiring_days=0, limit=None).count() == 8


def test_expiring_items(inventory):
    assert ids(stock.expiring_items(inventory, AS_OF, 3)) == [3, 1, 4, 9, 7]
    assert ids(stock.expiring_items(inventory, AS_OF, 0)) == [3, 1]


def test_expiring_bands(inventory):
    rows = stock.expiring_bands(inventory, AS_OF, 3).collect()
    bands = {}
    for r in rows:
        bands.setdefault(r.band, set()).add(r.item_id)
    assert bands == {"CRITICA_SCADUTO": {3}, "ALTA_SCADE_OGGI": {1}, "ALTA_SCADE_DOMANI": {4}, "MEDIA": {9, 7}}


def test_search(inventory):
    assert [r.search_id for r in stock.search_items(inventory, "fri").collect()] == [
        "alimento-9", "alimento-1", "alimento-3", "alimento-4"]
    sal = stock.search_items(inventory, "SAL").collect()
    assert [(r.search_id, r.title) for r in sal] == [("alimento-6", "Salmone (0.000 KG)")]
    assert [r.search_id for r in stock.search_items(inventory, "_5").collect()] == ["alimento-9"]
    assert stock.search_items(inventory, "").count() == 0


def test_items_per_category(inventory):
    got = {r.category: r["items"] for r in stock.items_per_category(inventory).collect()}
    assert got["LATTICINI"] == 3 and len(got) == 7 and got["PESCE"] == 1


def test_fetch(spark, inventory):
    req = spark.createDataFrame([("alimento-1",), ("alimento-99",), ("item-1",), ("alimento-x",)], "id string")
    got = {r.request_id: r for r in stock.fetch_items(inventory, req).collect()}
    assert got["alimento-1"].found and got["alimento-1"].quantity == "2.000 LITRI"
    assert got["alimento-1"].created == "2024-01-01 00:00:00"
    assert not got["alimento-99"].found and not got["item-1"].found and not got["alimento-x"].found


def test_bad_enum_argument_raises(inventory):
    import pytest

    with pytest.raises(ValueError):
        stock.list_stock(inventory, AS_OF, category="MEAT")
