"""Stock reads: list with filters, KPIs, expiring items and bands, search, fetch.

Filters are plain ``filter`` calls on the scan, so Catalyst pushes them into the
parquet reader; the limited lists become ``TakeOrderedAndProject`` (per-partition
top-k, then a merge of k rows per partition), never a full sort.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expressions as X


def _check_enum(value, labels, what: str) -> None:
    if value and value not in labels:
        raise ValueError(f"invalid {what}: {value!r}")


def in_stock(inventory: DataFrame, as_of, category=None, location=None,
             expiring_days=None, min_quantity=None) -> DataFrame:
    """Rows with ``quantity > 0`` and the optional filters. Each optional filter
    applies only when its argument is truthy (None, 0 and '' mean no filter);
    ``expiring_days`` keeps already expired rows."""
    _check_enum(category, S.CATEGORIES, "category")
    _check_enum(location, S.LOCATIONS, "location")
    df = inventory.filter(F.col("quantity") > 0)
    if X.truthy(category):
        df = df.filter(F.col("category") == category)
    if X.truthy(location):
        df = df.filter(F.col("location") == location)
    if X.truthy(min_quantity):
        df = df.filter(F.col("quantity") >= F.lit(Decimal(str(min_quantity))))
    if X.truthy(expiring_days):
        df = df.filter(F.col("expiry_date").isNotNull()
                       & (F.col("expiry_date") <= F.date_add(X.date_lit(as_of), int(expiring_days))))
    return df


def list_stock(inventory: DataFrame, as_of, category=None, location=None, expiring_days=None,
               min_quantity=None, limit: int | None = S.DEFAULT_LIMIT, sort: bool = True) -> DataFrame:
    """Stock list: soonest expiry first (no expiry last), then name, then id (in any
    order without ``sort``, for readers of all rows).

    A price of 0 is shown as null; ``days_left`` is whole days to expiry and
    ``alert`` is SCADUTO (past) or IN_SCADENZA (0 to 3 days)."""
    df = in_stock(inventory, as_of, category, location, expiring_days, min_quantity)
    days = X.days_left("expiry_date", as_of)
    df = df.select(
        "item_id", "name", "quantity", "unit", "category", "location", "expiry_date",
        days.alias("days_left"),
        F.when(F.col("price") != 0, F.col("price")).alias("price"),
        "supplier", "created_at", "updated_at",
        X.stock_alert(days).alias("alert"),
    )
    if sort:
        df = df.orderBy(F.col("expiry_date").asc_nulls_last(), F.col("name").asc(), F.col("item_id").asc())
    return df.limit(int(limit)) if limit is not None else df


def stock_kpis(inventory: DataFrame, as_of, category=None, location=None, expiring_days=None,
               min_quantity=None) -> DataFrame:
    """One row: products in stock, expired (expiry <= as_of), expiring in
    (as_of, as_of + 3], distinct categories and locations, all under the list's
    filters but without its limit. Over zero rows the two sums are null.

    Rows are first aggregated by category and location (a few dozen groups), so the two
    distinct counts run over the groups and no row is copied for them."""
    df = in_stock(inventory, as_of, category, location, expiring_days, min_quantity)
    today = X.date_lit(as_of)
    exp = F.col("expiry_date")
    groups = df.groupBy("category", "location").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(exp.isNotNull() & (exp <= today), 1).otherwise(0)).alias("expired"),
        F.sum(F.when(exp.isNotNull() & (exp <= F.date_add(today, 3)) & (exp > today), 1).otherwise(0)).alias("expiring"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_products"),
        F.sum("expired").cast("bigint").alias("expired"),
        F.sum("expiring").cast("bigint").alias("expiring_3_days"),
        F.count_distinct("category").alias("distinct_categories"),
        F.count_distinct("location").alias("distinct_locations"),
    )


def list_counts(filtered: DataFrame, limit: int | None = S.DEFAULT_LIMIT) -> DataFrame:
    """One row: the rows under a list's filters, and how many of them its page shows."""
    total = F.count(F.lit(1))
    return filtered.agg(total.alias("total"), (total if limit is None else F.least(total, F.lit(int(limit)))).alias("shown"))


def expiring_items(inventory: DataFrame, as_of, days: int = 3, category=None, location=None,
                   sort: bool = True) -> DataFrame:
    """Items in stock whose expiry is known and at most ``days`` days after
    ``as_of`` (already expired included; ``days = 0`` is honoured), earliest first.
    Category and location narrow the same scan (no self-join)."""
    if days is None:
        days = 3
    _check_enum(category, S.CATEGORIES, "category")
    _check_enum(location, S.LOCATIONS, "location")
    today = X.date_lit(as_of)
    df = inventory.filter(F.col("expiry_date").isNotNull()
                          & (F.col("expiry_date") <= F.date_add(today, int(days)))
                          & (F.col("quantity") > 0))
    if X.truthy(category):
        df = df.filter(F.col("category") == category)
    if X.truthy(location):
        df = df.filter(F.col("location") == location)
    df = df.select("item_id", "name", "quantity", "unit", "expiry_date",
                   X.days_left("expiry_date", as_of).alias("days_left"), "category", "location")
    return df.orderBy("expiry_date", "item_id") if sort else df


def expiring_bands(inventory: DataFrame, as_of, days: int = 3, category=None, location=None) -> DataFrame:
    """The expiring items, each with its urgency band (CRITICA_SCADUTO,
    ALTA_SCADE_OGGI, ALTA_SCADE_DOMANI, MEDIA). Long form: one row per item, so no
    band's rows are ever gathered into one value."""
    df = expiring_items(inventory, as_of, days, category, location, sort=False)
    return df.withColumn("band", X.expiry_band(F.col("days_left")))


def expiring_band_counts(inventory: DataFrame, as_of, days: int = 3, category=None, location=None) -> DataFrame:
    """Items per urgency band (the size of each band's list)."""
    return (expiring_bands(inventory, as_of, days, category, location)
            .groupBy("band").agg(F.count(F.lit(1)).alias("items")))


def items_per_category(inventory: DataFrame) -> DataFrame:
    """Items per category, exhausted items included."""
    return inventory.groupBy("category").agg(F.count(F.lit(1)).alias("items"))


def search_items(inventory: DataFrame, query: str, limit: int | None = S.SEARCH_LIMIT) -> DataFrame:
    """Case-insensitive substring search over name, category and location, with no
    stock filter; ``%`` and ``_`` in the query are wildcards. An empty query finds
    nothing. Ordered by name (bytes), then id."""
    pattern = X.like_contains(query or "")
    p = F.lower(F.lit(pattern))
    df = inventory.filter(F.lit(bool(query))
                          & (F.like(F.lower("name"), p) | F.like(F.lower("category"), p)
                             | F.like(F.lower("location"), p)))
    df = df.select(
        F.concat(F.lit(S.SEARCH_ID_PREFIX), F.col("item_id").cast("string")).alias("search_id"),
        F.concat(F.col("name"), F.lit(" ("), F.col("quantity").cast("string"), F.lit(" "),
                 F.col("unit"), F.lit(")")).alias("title"),
        "category", "location", "name", "item_id",
    ).orderBy("name", "item_id")
    if limit is not None:
        df = df.limit(int(limit))
    return df.drop("name", "item_id")


def fetch_items(inventory: DataFrame, requests: DataFrame, id_col: str = "id") -> DataFrame:
    """Documents for a frame of text ids ``alimento-<n>``: one row per request,
    ``found`` false with null fields for a bad id or a missing item.

    A bulk key lookup: an equi-join on the parsed id (left outer, so every request
    answers)."""
    raw = F.col(id_col)
    parsed = F.when(raw.startswith(S.SEARCH_ID_PREFIX),
                    F.trim(F.regexp_replace(raw, S.SEARCH_ID_PREFIX, "")).try_cast("bigint"))
    req = requests.select(raw.alias("request_id"), parsed.alias("_key"))
    inv = inventory.select(
        F.col("item_id").alias("_key"), "name",
        F.concat(F.col("quantity").cast("string"), F.lit(" "), F.col("unit")).alias("quantity"),
        "category", "location",
        X.iso_date("expiry_date").alias("expiry_date"),
        X.iso_timestamp("created_at", sep=" ").alias("created"),
        X.iso_timestamp("updated_at", sep=" ").alias("modified"),
    )
    inv = inv.withColumn("_found", F.lit(True))
    out = req.join(inv, "_key", "left")
    return out.select("request_id", F.coalesce("_found", F.lit(False)).alias("found"),
                      "name", "quantity", "category", "location", "expiry_date", "created", "modified")


def search_counts(inventory: DataFrame, query: str, limit: int | None = S.SEARCH_LIMIT) -> DataFrame:
    """One row: the items that match a search, and how many of them the answer shows."""
    return list_counts(search_items(inventory, query, None), limit)


# Field names of a search result and of a fetched item in the JSON answers, in order.
SEARCH_FIELDS = (("id", "search_id"), ("title", "title"), ("category", "category"), ("location", "location"))
FETCH_FIELDS = (("id", "request_id"), ("name", "name"), ("quantity", "quantity"), ("category", "category"),
                ("location", "location"), ("expiry_date", "expiry_date"), ("created", "created"), ("modified", "modified"))


def _document(fields) -> Column:
    return F.to_json(F.struct(*[F.col(c).alias(k) for k, c in fields]), {"ignoreNullFields": "false"})


def search_json(found: DataFrame) -> DataFrame:
    """One JSON document per search result (``search_id``, ``json``)."""
    return found.select("search_id", _document(SEARCH_FIELDS).alias("json"))


def fetch_json(fetched: DataFrame) -> DataFrame:
    """One JSON document per fetch request (``request_id``, ``json``); a request that finds
    nothing answers with an error code."""
    error = F.to_json(F.struct(F.lit("NOT_FOUND").alias("error")))
    return fetched.select("request_id", F.when(F.col("found"), _document(FETCH_FIELDS)).otherwise(error).alias("json"))


# Field names of a stock-list entry in the JSON answer, in order.
JSON_FIELDS = (("id", "item_id"), ("nome", "name"), ("quantita", "quantity"), ("unita_misura", "unit"),
               ("categoria", "category"), ("ubicazione", "location"), ("data_scadenza", "expiry_date"),
               ("giorni_alla_scadenza", "days_left"), ("prezzo_acquisto", "price"),
               ("fornitore", "supplier"), ("data_inserimento", "created_at"),
               ("ultima_modifica", "updated_at"))


def stock_list_json(listed: DataFrame) -> DataFrame:
    """One JSON document per stock-list row (``item_id``, ``json``): decimals as
    floats, dates and timestamps as ISO text, nulls written, and the ``alert``
    key only when there is an alert. A sink writes it with ``write.text``."""
    fields = []
    for key, col in JSON_FIELDS:
        c = F.col(col)
        if col in ("quantity", "price"):
            c = c.cast("double")
        elif col == "expiry_date":
            c = X.iso_date(c)
        elif col in ("created_at", "updated_at"):
            c = X.iso_timestamp(c)
        fields.append(c.alias(key))
    opts = {"ignoreNullFields": "false"}
    plain = F.to_json(F.struct(*fields), opts)
    alerted = F.to_json(F.struct(*fields, F.col("alert").alias("alert")), opts)
    return listed.select("item_id", F.when(F.col("alert").isNull(), plain).otherwise(alerted).alias("json"))


# Field names of an expiring item in the JSON answer, in order.
EXPIRING_FIELDS = (("id", "item_id"), ("nome", "name"), ("quantita", "quantity"), ("unita_misura", "unit"),
                   ("data_scadenza", "expiry_date"), ("giorni_alla_scadenza", "days_left"), ("categoria", "category"),
                   ("ubicazione", "location"), ("priorita", "band"))


def expiring_json(banded: DataFrame) -> DataFrame:
    """One JSON document per expiring item (``item_id``, ``json``), its band a field, so
    that no band's items are gathered into one value."""
    fields = [F.col(c).cast("double") if c == "quantity" else X.iso_date(F.col(c)) if c == "expiry_date" else F.col(c)
              for _, c in EXPIRING_FIELDS]
    document = F.struct(*[v.alias(k) for v, (k, _) in zip(fields, EXPIRING_FIELDS)])
    return banded.select("item_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))
