"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows (13 words, or a whole shorter item). For each
pattern length a shift table over blocks of two words tells how far the search may move
on: positions with a positive shift cannot end an occurrence and are skipped. A zero
shift leads to the bucket of patterns that end in the same block; of those, the ones
whose whole window hashes alike are compared word for word with the text.

Repeated benchmark rows count once, long items are cut into pieces that overlap by a
window less one word, and the pieces go to the tasks in blocks of at most ``block_bytes``
of text and one piece (a quarter of that, or 13 longer words). The tables of a block are
a few packed arrays, some 20 bytes a word. A benchmark of one block is one narrow pass
over the documents. With more, the documents are stored once with a number for each row;
each block's pass writes the rows that it hits and no texts, and the hits of a row are
put together by its number. So neither the driver nor a task ever holds more than one
block, and a task runs one Python worker, however large the benchmark is.

Defined cases: a null or empty text has no words and is clean; items without words match
nothing; items with a null id mark words but are not counted or listed; repeated items
count once by id; a very long text is searched whole; an empty benchmark leaves every
document clean; carried columns that clash with result columns give way to them, any
other name may occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.running import running_sum
from larder.llm.columns import ALNUM, LOWER, Rolling, before, map_text, mix, small_batches, spans, utf8, windows
from larder.llm.shared import stored

WINDOW = 13
BLOCK = 2
SHIFT_BITS = 16
BLOCK_BYTES = 2 << 20
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
          T.StructField("contaminated", T.BooleanType()), T.StructField("items", T.ArrayType(T.StringType())),
          T.StructField("hit_ranges", T.ArrayType(T.LongType()))]


class WuManber:
    """Shift and bucket tables of all patterns of one length (in words). ``key`` is, in
    order, the slot of a pattern's last block and the rest of its window's hash; ``at`` is
    the benchmark word that the pattern begins with."""

    def __init__(self, length: int, word_hash: np.ndarray, begins: np.ndarray):
        self.length, self.block = length, min(BLOCK, length)
        self.far = length - self.block + 1
        block_hash = blocks(word_hash, self.block)
        self.shift = np.full(1 << SHIFT_BITS, self.far, np.int16)
        for end in range(self.far):
            slot = (block_hash[begins + end] >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)
            np.minimum.at(self.shift, slot, np.int16(self.far - 1 - end))
        key = self.keys(block_hash, windows(word_hash, length), begins)
        order = np.argsort(key, kind="stable")
        self.key, self.at = key[order], begins[order].astype(np.uint32)

    def keys(self, block_hash: np.ndarray, window_hash: np.ndarray, begins: np.ndarray) -> np.ndarray:
        slot = block_hash[begins + self.far - 1] >> np.uint64(64 - SHIFT_BITS)
        return (slot << np.uint64(64 - SHIFT_BITS)) | (window_hash[begins] >> np.uint64(SHIFT_BITS))

    def ends(self, block_hash: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Block positions where a pattern may end. Each stretch of ``far`` blocks is a
        lane of its own; all lanes move on together, each by its own shift."""
        counts = np.maximum(0, -(-(stop - first) // self.far))
        lane_text = np.repeat(np.arange(len(first)), counts)
        step = np.arange(len(lane_text)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = first[lane_text] + step * self.far
        end = np.minimum(at + self.far, stop[lane_text])
        found = []
        while len(at):
            shift = self.shift[(block_hash[at] >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            on = at < end
            at, end = at[on], end[on]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Tables:
    """A block of the benchmark: its words, and the search tables of each pattern length."""

    def __init__(self, items: Sequence[tuple], window: int = WINDOW):
        self.ids = [item for item, _ in items]
        data, starts, ends, self.word_at, hashes = tokenized(pa.array([t for _, t in items], pa.string()))
        self.raw, self.starts, self.ends = data.tobytes(), starts.astype(np.uint32), ends.astype(np.uint32)
        n_words = np.diff(self.word_at)
        self.searchers = []
        for length in np.unique(np.minimum(n_words[n_words > 0], window)).tolist():
            own = np.flatnonzero(n_words >= window if length == window else n_words == length)
            size = n_words[own] - length + 1
            begins = np.repeat(self.word_at[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            self.searchers.append(WuManber(length, hashes, begins))

    def words(self, at: int, length: int) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.starts[at:at + length].tolist(), self.ends[at:at + length].tolist())]

    def owner(self, at: int):
        return self.ids[int(np.searchsorted(self.word_at, at, side="right")) - 1]

    def nbytes(self) -> int:
        arrays = [self.starts, self.ends, self.word_at, *[x for t in self.searchers for x in (t.key, t.at)]]
        return len(self.raw) + sum(x.nbytes for x in arrays)


def blocks(word_hash: np.ndarray, size: int) -> np.ndarray:
    """The hash of each block of ``size`` neighbouring words."""
    return mix(word_hash) if size == 1 else windows(word_hash, size)


def tokenized(column: pa.Array):
    """Lower-cased bytes, word starts and ends, first word of each text, word hashes."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends = spans(ALNUM[data], offsets)
    return data, starts, ends, before(offsets, starts), Rolling(data).of(starts, ends)


def occurrences(tables: Tables, column: pa.Array):
    """Per text of a slice: its number of words, hit word ranges and items found."""
    data, starts, ends, word_at, hashes = tokenized(column)
    n_texts = len(column)
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
    items: list[set] = [set() for _ in range(n_texts)]
    raw = None
    for t in tables.searchers:
        if len(hashes) < t.length:
            continue
        block_hash, codes = blocks(hashes, t.block), windows(hashes, t.length)
        # blocks that may end a pattern: from the pattern's last block of the first window on
        first = word_at[:-1] + t.length - t.block
        stop = np.maximum(first, word_at[1:] - t.block + 1)
        begin = t.ends(block_hash, first, stop) - (t.length - t.block)
        wanted = t.keys(block_hash, codes, begin)
        low, high = np.searchsorted(t.key, wanted, side="left"), np.searchsorted(t.key, wanted, side="right")
        some = np.flatnonzero(high > low)
        raw = data.tobytes() if raw is None and len(some) else raw
        texts = np.searchsorted(word_at, begin[some], side="right") - 1
        known: dict[tuple, set] = {}  # a window that occurs again need not be compared again
        for k, d in zip(some.tolist(), texts.tolist()):
            b = int(begin[k])
            words = [raw[s:e] for s, e in zip(starts[b:b + t.length].tolist(), ends[b:b + t.length].tolist())]
            found = known.get(key := (int(low[k]), *words))
            if found is None:
                same = [int(x) for x in t.at[low[k]:high[k]] if tables.words(int(x), t.length) == words]
                found = known[key] = {tables.owner(x) for x in same}
            if found:
                items[d] |= found
                b -= int(word_at[d])
                if ranges[d] and ranges[d][-1][1] >= b >= ranges[d][-1][0]:
                    ranges[d][-1] = (ranges[d][-1][0], max(ranges[d][-1][1], b + t.length))
                else:
                    ranges[d].append((b, b + t.length))
    return np.diff(word_at), ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def pieces(benchmark: DataFrame, item_id: str, item_text: str, window: int, piece_bytes: int) -> DataFrame:
    """(i, t): the different benchmark rows, long texts cut into overlapping runs of words of
    at most ``piece_bytes`` bytes (and at least ``window`` words)."""
    small_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, item in enumerate(batch.column(0).to_pylist()):
                column = batch.column(1).slice(k, 1)
                data, starts, ends, _, _ = tokenized(column)
                raw, lo, n = data.tobytes(), 0, len(starts)
                while lo < n:
                    hi = min(n, max(lo + window, int(np.searchsorted(ends, starts[lo] + piece_bytes, side="right"))))
                    text = raw[starts[lo]:ends[hi - 1]].decode()
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([text], pa.string())], names=["i", "t"])
                    lo = hi - window + 1 if hi < n else n

    return rows.filter("t is not null").distinct().mapInArrow(run, "i string, t string")


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", carry: Sequence[str] | None = None, window: int = WINDOW,
                  percent: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with, for every text, its words, the words inside benchmark windows
    (``hit_ranges``: first word and word after the last, flattened), the items found and
    the verdict: hit words are at least ``percent`` percent of all."""
    cut = pieces(benchmark, item_id, item_text, window, max(1, block_bytes // 4)).withColumn("h", F.xxhash64("i", "t"))
    placed = running_sum(cut, [], ["h", "i", "t"], "upto", F.octet_length("t"))
    placed = stored(placed.select("i", "t", F.floor((F.col("upto") - 1) / block_bytes).alias("block")), "benchmark-pieces")
    parts = (placed.agg(F.max("block")).first()[0] or 0) + 1

    def tables(k: int):
        own = placed.filter(F.col("block") == k).select("i", "t").collect()  # at most block_bytes and one piece
        return df.sparkSession.sparkContext.broadcast(Tables([tuple(r) for r in own], window))

    taken = {f.name for f in FIELDS}
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in taken]
    if parts == 1:
        return _pass(df, text, tables(0), kept, percent)
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None).cast("string")
    docs = df.select(row.alias("__row"), F.col(f"`{text}`").cast("string").alias("__x"))
    docs = stored(docs.withColumn("__id", F.monotonically_increasing_id()), "numbered-documents")
    hits, counted = [], None
    for k in range(parts):
        found = _pass(docs, "__x", tables(k), ["__id"], percent)
        if counted is None:
            counted = found = stored(found.select("__id", "n_words", "items", "hit_ranges"), "benchmark-hits")
        hits.append(stored(found.filter(F.size("hit_ranges") > 0).select("__id", "items", "hit_ranges"), "benchmark-hits"))
    union = hits[0]
    for more in hits[1:]:
        union = union.unionByName(more)
    # one row for each block that hits a document, so a list is bounded by that text's own hits
    together = union.groupBy("__id").agg(F.collect_list("items").alias("items"), F.collect_list("hit_ranges").alias("hit_ranges"))
    lists = docs.select("__id", "__row").join(counted.select("__id", "n_words"), "__id").join(
        together.select("__id", F.flatten("items").alias("found"), F.flatten("hit_ranges").alias("ranges")), "__id", "left")
    schema = T.StructType([lists.schema["__row"], *FIELDS])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found, flat = (batch.column(c).to_pylist() for c in ("n_words", "found", "ranges"))
            ranges = [list(zip((x or [])[::2], (x or [])[1::2])) for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), *_rows(n_words, ranges, [set(x or ()) for x in found], percent)],
                                             names=schema.names)

    done = lists.mapInArrow(finish, schema)
    return done.select(*[F.col("__row")[c].alias(c) for c in kept], *schema.names[1:])


def _pass(df: DataFrame, text: str, tables, carry: Sequence[str], percent: int) -> DataFrame:
    """One block of the benchmark against every text."""
    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            n_words, ranges, items = occurrences(tables.value, column)
            return _rows(n_words.tolist(), ranges, items, percent)
        return run

    return map_text(df, text, FIELDS, make, carry)


def _rows(n_words: list[int], ranges, items, percent: int) -> list[pa.Array]:
    out: list[list] = [[] for _ in FIELDS]
    for n, own, ids in zip(n_words, ranges, items):
        hit = merged(own)
        found = sorted(x for x in ids if x is not None)
        n_hit = sum(hi - lo for lo, hi in hit)
        values = (n, n_hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(),
                  n_hit > 0 and 100 * n_hit >= percent * n, found, [x for r in hit for x in r])
        for column_out, value in zip(out, values):
            column_out.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int64()))
    return [pa.array(x, kind) for x, kind in zip(out, kinds)]
