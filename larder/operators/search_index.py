"""Search through trigram postings.

A posting says that a field of an item holds a trigram (three characters, lower case). A
search cuts the literal runs of its pattern into trigrams; an item can only match if one
field holds all of them, so candidates are the (item, field) pairs with every trigram, and
the exact pattern is tested on the candidates alone. The postings are sorted by trigram in
ranges, so a search reads the row groups of its trigrams. A pattern without three literal
characters in a row has no trigram: it is searched by a scan, with the same answer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from . import stock

FIELDS = ("name", "category", "location")
SIZE = 3


def postings(inventory: DataFrame) -> DataFrame:
    """(trigram, item_id, field): each trigram of a field once."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(f).alias("text")) for f in FIELDS])
    rows = inventory.select("item_id", F.explode(fields).alias("f")).select("item_id", "f.field", "f.text").filter(F.length("text") >= SIZE)
    grams = F.expr(f"array_distinct(transform(sequence(1, length(text) - {SIZE - 1}), i -> substring(text, i, {SIZE})))")
    return rows.select(F.explode(grams).alias("trigram"), "item_id", "field")


def write(inventory: DataFrame, path: str) -> None:
    """The postings as a table in ranges of the trigram."""
    postings(inventory).repartitionByRange("trigram", "item_id").sortWithinPartitions("trigram", "item_id").write.mode("overwrite").parquet(path)


def trigrams(query: str) -> list[str]:
    """The trigrams that every match of the query holds, in lower case. ``%`` and ``_`` are
    wildcards; runs are cut at characters whose lower case has another length or form in
    the engine (non-ASCII), so no match can lack a trigram."""
    runs = re.findall(r"[^%_\x80-\U0010ffff]+", query)
    return sorted({run[i:i + SIZE].lower() for run in runs for i in range(len(run) - SIZE + 1)})


def search(spark: SparkSession, path: str, inventory: DataFrame, query: str, limit: int | None = S.SEARCH_LIMIT) -> DataFrame:
    """``stock.search_items`` through the postings at ``path``."""
    grams = trigrams(query or "")
    if not grams:
        return stock.search_items(inventory, query, limit)
    found = (spark.read.parquet(path).filter(F.col("trigram").isin(grams)).groupBy("item_id", "field")
             .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= len(grams)).select("item_id").distinct())
    return stock.search_items(inventory.join(found, "item_id", "left_semi"), query, limit)
