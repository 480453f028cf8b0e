"""Shared plumbing of the text operators: bounded Arrow slices, UTF-8 views of text
columns as numpy bytes, word boundaries and rolling hashes.

Everything here runs inside a task on one slice of one Arrow batch, so memory is
bounded by the slice (``SLICE_BYTES`` or one single longer text), not by a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows, so that long texts cannot pile up
    by the ten thousand in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it (whatever its case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with those of its columns renamed that have one of the given names, and how to
    rename them back (``withColumnsRenamed``)."""
    clash = [c for c in df.columns if c.lower() in names]
    renamed: dict[str, str] = {}
    for c in clash:
        renamed[c] = free_name(f"{c}_", [*df.columns, *names, *renamed.values()])
    return df.withColumnsRenamed(renamed) if renamed else df, {v: k for k, v in renamed.items()}


def map_text(df: DataFrame, text: str, fields: Sequence[T.StructField], make: Callable[[], Callable],
             carry: Sequence[str] | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``df``'s ``carry`` columns (all by default) with result columns computed from the
    text column, by one narrow ``mapInArrow``.

    ``make()`` runs once a task and returns a function from an Arrow string array to a
    list of Arrow arrays, one for each of ``fields``. A carried column whose name
    clashes with a result column (whatever its case) gives way to the result.
    """
    small_batches(df.sparkSession)
    taken = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in taken]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(free_name("__text__", kept)))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    names, n_kept = schema.names, len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            column = batch.column(n_kept)
            for lo, hi in cuts(column, slice_bytes):
                out = fn(column.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(n_kept)] + out, names=names)

    return source.mapInArrow(run, schema)


def cuts(column: pa.Array, slice_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``slice_bytes`` bytes of text, at least one row each."""
    _, offsets = utf8(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + slice_bytes, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the offsets of each (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    buffer = flat.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member`` bytes, cut at text borders."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    full = offsets[1:] > offsets[:-1]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    first[head], last[tail] = member[head], member[tail]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def before(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """How many of the sorted ``positions`` lie before each text offset."""
    return np.searchsorted(positions, offsets, side="left")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


class Rolling:
    """Prefix sums of a polynomial hash over bytes: the 64-bit hash of any byte range
    in constant time."""

    def __init__(self, data: np.ndarray):
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = _power(_INVERSE, len(self.prefix))
        return mix((self.prefix[ends] - self.prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def windows(word_hash: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` neighbouring words (of the whole slice: the caller
    leaves out those that cross a text border)."""
    count = max(0, len(word_hash) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + word_hash[k:k + count]
    return mix(out + np.uint64(n))


def covered(n_items: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n_items`` positions lie in any of the ranges [start, start + length)."""
    step = np.zeros(n_items + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n_items), -1)
    return np.cumsum(step[:-1]) > 0


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``bounds``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


#: Words between ASCII white space: every byte but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and every non-ASCII byte.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
