"""Sharding by histogram sort.

Documents are ordered by a uniform key: hash of the text, then hash of the id, then the
row's number. Equal texts are therefore neighbours. Probes split the key range; each
round counts the exact bytes and rows between neighbouring probes over all partitions
(one partial aggregate, one small row a probe), and only intervals that still hold a
wanted splitter, or too many rows to number in one task, get finer probes. When every
splitter is within the tolerance, the rows are exchanged once, by interval, and numbered
inside it. A splitter falls inside a group of equal texts only if no border of the group
is within the tolerance.

Defined cases: a null text counts as empty (size 1, crc 0); null ids and repeated rows
are told apart by row number; an empty table gives no rows; columns of ``df`` that clash
with result columns give way to them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.columns import set_aside
from larder.llm.shared import stored

DIGITS = 48  # of a key: 16 hexadecimal digits each for text, id and row number
GROUP = 16  # the digits that equal texts share
FIRST_PROBES = 2048
FINER = 16
TOLERANCE = 0.01
PARTS = 512


@dataclass
class Interval:
    low: str
    size: int
    rows: int
    least: str
    most: str


#: Names of columns that only live inside.
INSIDE = ("__text", "__id", "__row", "__key", "__part", "__rank", "__base")


def keyed(df: DataFrame, text: str, id_column: str) -> DataFrame:
    """``df`` with size, crc and sort key; the text itself only if it is a column of the
    caller's choice. Written once, so that row numbers stay as they are."""
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return df.select("*", (F.octet_length(content) + 1).cast("long").alias("size"),
                     F.crc32(content.cast("binary")).alias("text_crc32"),
                     F.xxhash64(content).alias("__text"), F.xxhash64(F.col(f"`{id_column}`")).alias("__id"),
                     F.monotonically_increasing_id().alias("__row"))


def sort_key() -> F.Column:
    return F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("__text", "__id", "__row")])


def interval_of(lows: list[str]):
    """A column function: the number of the interval that a key lies in."""
    ranked = np.array(lows, f"S{DIGITS}")

    @F.pandas_udf(T.IntegerType())
    def number(key: pd.Series) -> pd.Series:
        keys = key.to_numpy().astype(f"S{DIGITS}")
        return pd.Series(np.searchsorted(ranked, keys, side="right") - 1, dtype="int32")

    return number


def count(keys: DataFrame, lows: list[str]) -> list[Interval]:
    """Exact bytes and rows between neighbouring probes: one row for each on the driver."""
    rows = (keys.select(interval_of(lows)("key").alias("k"), "size", "key").groupBy("k")
            .agg(F.sum("size"), F.count("*"), F.min("key"), F.max("key")).collect())
    return [Interval(lows[k], int(size), int(n), least, most) for k, size, n, least, most in sorted(rows)]


def probes(low: str, high: str, n: int) -> list[str]:
    """``n`` keys that split the range from ``low`` to ``high`` evenly, the last at
    ``high``; on borders of text groups while the range holds more than one text."""
    digits = GROUP if low[:GROUP] != high[:GROUP] else DIGITS
    a, b = int(low[:digits], 16), int(high[:digits], 16)
    return sorted({f"{a + -(-(b - a) * i // n):0{digits}X}".ljust(DIGITS, "0") for i in range(1, n + 1)})


def refine(keys: DataFrame, shards: int, tolerance: float, parts: int) -> tuple[list[Interval], list[str]]:
    """The final intervals and the ``shards - 1`` splitters."""
    width = 16 ** GROUP
    lows = sorted({f"{width * i // FIRST_PROBES:0{GROUP}X}".ljust(DIGITS, "0") for i in range(FIRST_PROBES)})
    found = count(keys, lows)
    while True:
        total, n_rows = sum(x.size for x in found), sum(x.rows for x in found)
        most_rows = max(1, n_rows // parts)
        below = np.cumsum([0, *[x.size for x in found]]).tolist()
        goals = [total * i / shards for i in range(1, shards)]
        open_ = {k for k, x in enumerate(found) if x.rows > most_rows and x.least != x.most}
        splitters = []
        for goal in goals:
            k = bisect_right(below, goal) - 1
            near = min(range(max(0, k), min(k + 2, len(below))), key=lambda i: abs(below[i] - goal), default=0)
            splitters.append(found[near].low if near < len(found) else "G")
            inside = k < len(found) and found[k].least != found[k].most
            if inside and abs(below[near] - goal) > tolerance * total / shards:
                open_.add(k)
        if not open_:
            return found, splitters
        finer = [p for k in sorted(open_) for p in [found[k].least, *probes(found[k].least, found[k].most, FINER)]]
        lows = sorted({*[x.low for x in found], *finer})
        edges = [x.low for x in found]
        redo = sorted({bisect_right(edges, p) - 1 for p in finer})
        changed = keys.filter(interval_of(edges)("key").isin([int(k) for k in redo])) if len(redo) <= shards else keys
        again = count(changed, lows)
        kept = [x for k, x in enumerate(found) if k not in redo] if changed is not keys else []
        found = sorted(kept + again, key=lambda x: x.low)


def shard(df: DataFrame, shards: int = 16, text: str = "text", id_column: str = "doc_id",
          carry: Sequence[str] | None = None, tolerance: float = TOLERANCE, parts: int = PARTS) -> DataFrame:
    """``df``'s ``carry`` columns (all by default) with ``size``, ``text_crc32``, the
    ``shard`` (0 to ``shards`` - 1, sizes near equal) and the gapless ``slot`` in it."""
    results = {"size", "text_crc32", "shard", "slot"}
    names = [c for c in (df.columns if carry is None else carry) if c.lower() not in results]
    plain, back = set_aside(df.select(*[F.col(f"`{c}`") for c in {*names, text, id_column}]), INSIDE)
    now = {old: new for new, old in back.items()}
    names, text, id_column = [now.get(c, c) for c in names], now.get(text, text), now.get(id_column, id_column)
    source = keyed(plain, text, id_column).select(*[F.col(f"`{c}`") for c in names], "size", "text_crc32", "__text", "__id", "__row")
    source = stored(source, "shard-keys")
    keys = source.select(sort_key().alias("key"), "size")
    found, splitters = refine(keys, shards, tolerance, parts)

    lows = [x.low for x in found] or ["0" * DIGITS]
    shard_of = [bisect_right(splitters, x) for x in lows]
    base, at, previous = [], 0, -1
    for x, s in zip(found, shard_of):
        at = 0 if s != previous else at
        base.append(at)
        at, previous = at + x.rows, s
    numbers = df.sparkSession.createDataFrame(
        [(i, s, b) for i, (s, b) in enumerate(zip(shard_of, base or [0]))], "__part int, shard int, __base bigint")
    parted = source.withColumn("__key", sort_key()).withColumn("__part", interval_of(lows)("__key"))
    order = Window.partitionBy("__part").orderBy("__key")
    ranked = parted.withColumn("__rank", F.row_number().over(order) - 1)
    return ranked.join(F.broadcast(numbers), "__part").select(
        *[F.col(f"`{c}`") for c in names], "size", "text_crc32", "shard", (F.col("__base") + F.col("__rank")).alias("slot")).withColumnsRenamed(back)
