"""Near-duplicate groups by one-permutation MinHash.

Every text's set of word shingles is hashed once; the hash space is cut into ``SLOTS``
slots, the least hash of each slot is its sketch, and empty slots borrow from full ones
by optimal densification (each empty slot draws its own sequence of slots). Bands of
sketch slots give buckets. Sets of at most ``FEW`` shingles have too few for a sketch: their
buckets are their rarest shingles, so many that similar sets must share one (exact), and
sets that are at most a third larger are in those buckets too.

Texts with equal sets are one class, and from there on one row. In a bucket every class
gets one edge to one centre, so a bucket of k classes gives k - 1 candidate pairs. A pair
is ruled out only by bounds that cannot err: the sizes, and the number of shingles that
each small stretch of the hash space holds (the smaller counts add up to no less than the
intersection). The rest is confirmed on the full sets. Buckets that still hold several
components are searched once more: each class outside the bucket's largest component is
compared with every class of another component (the centre, which has met them all,
apart), inside tasks of bounded classes and bytes that return only links. So no link
between two texts that share a bucket is lost, and no pair rows beyond the stars exist.
(Two texts of more than ``FEW`` shingles at the threshold share none of the 51 buckets with a
probability of about one in a million.)

Components come from label propagation with pointer jumping on the component graph;
links, labels and fingerprints stay in Spark tables of the shared folder.

Defined cases: null and empty texts have an empty set, are linked with nothing and are
kept; texts with fewer words than a shingle are one shingle, the whole sequence; of a
null id the component is the least id of its group, if any; repeated rows are members of
one class and all of them kept if they carry the component's id; an empty table gives no
rows; columns that clash with result columns give way to them, any other name may occur.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.columns import LOWER, SPACED, Rolling, before, map_text, mix, spans, utf8, windows
from larder.llm.shared import stored

SHINGLE = 5
PERCENT = 75
SLOTS = 256
ROWS = 5
BANDS = SLOTS // ROWS
#: Sets of at most so many shingles meet in buckets of rare shingles.
FEW = 64
#: The band of such a bucket.
RARE = BANDS
#: Most stretches of the hash space whose shingles are counted.
MOST_COUNTS = 1 << 16
#: Bits of the sieve that keeps unwanted rows out of a shuffle.
SIEVE_BITS = 1 << 25
#: Most classes of a bucket that one task compares with each other; larger buckets are cut
#: into blocks, and every pair of blocks is a task.
BLOCK = 1024
#: Most bytes of text in a block (or one longer text).
BLOCK_BYTES = 8 << 20
RESULTS = ("n_shingles", "component_id", "kept")
FINGERPRINT = [T.StructField("n_shingles", T.LongType()), T.StructField("__set", T.BinaryType()),
               T.StructField("__sketch", T.BinaryType()), T.StructField("__counts", T.BinaryType()),
               T.StructField("__few", T.ArrayType(T.LongType()))]


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after another, and how
    many each has."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends = spans(SPACED[data], offsets)
    word_at = before(offsets, starts)
    hashes = Rolling(data).of(starts, ends)
    grams = windows(hashes, size)
    short = {n: windows(hashes, n) for n in range(1, size)}
    out, counts = [], []
    for lo, hi in zip(word_at[:-1].tolist(), word_at[1:].tolist()):
        n = hi - lo
        own = np.unique(grams[lo:hi - size + 1]) if n >= size else short[n][lo:lo + 1] if n else grams[:0]
        out.append(own)
        counts.append(len(own))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(counts, np.int64)


def sketches(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of ``SLOTS`` 16-bit codes for each text that has shingles."""
    full = np.flatnonzero(counts)
    owner = np.repeat(np.arange(len(full)), counts[full])
    cell = owner * SLOTS + (hashes >> np.uint64(56)).astype(np.int64)
    first = np.r_[True, cell[1:] != cell[:-1]] if len(cell) else np.zeros(0, bool)
    out = np.zeros(len(full) * SLOTS, np.uint16)
    has = np.zeros(len(out), bool)
    out[cell[first]] = (hashes[first] & np.uint64(0xFFFF)).astype(np.uint16)
    has[cell[first]] = True
    empty = np.flatnonzero(~has)
    attempt = 0
    while len(empty):
        attempt += 1
        slot = (empty % SLOTS).astype(np.uint64)
        draw = mix(slot * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) & np.uint64(SLOTS - 1)
        source = empty - empty % SLOTS + draw.astype(np.int64)
        ok = has[source]
        out[empty[ok]] = out[source[ok]]
        empty = empty[~ok]
    return out.reshape(len(full), SLOTS)


def stretch_counts(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes lie in each stretch of the hash space: one byte each
    (255: that or more), about as many stretches as hashes, a power of two."""
    bits = min(max(len(hashes).bit_length() - 1, 4), MOST_COUNTS.bit_length() - 1)
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def most_shared(x: bytes, y: bytes) -> int:
    """No less than the hashes that two sets share."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    a, b = (np.where(v == 255, 1 << 40, v) for v in (a, b))
    size = min(len(a), len(b))
    return int(np.minimum(a.reshape(size, -1).sum(axis=1), b.reshape(size, -1).sum(axis=1)).sum())


def fingerprint(column: pa.Array, percent: int) -> list[pa.Array]:
    hashes, counts = shingle_sets(column)
    n = len(counts)
    full, ends = np.flatnonzero(counts), np.cumsum(counts)
    begin = (ends - counts)[full]
    if len(full):
        a = np.add.reduceat(mix(hashes), begin)
        b = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), begin)
        keys = np.stack([a, b], axis=1).astype("<u8")
    many = counts > FEW
    codes = sketches(hashes[np.repeat(many, counts)], np.where(many, counts, 0))
    sets, rows, held, few = [None] * n, [None] * n, [None] * n, [None] * n
    for k, i in enumerate(full.tolist()):
        own = hashes[ends[i] - counts[i]:ends[i]]
        sets[i], held[i] = keys[k].tobytes(), stretch_counts(own)
        if percent * counts[i] <= 100 * FEW:
            few[i] = own.view(np.int64)
    for k, i in enumerate(np.flatnonzero(many).tolist()):
        rows[i] = codes[k].tobytes()
    return [pa.array(counts, pa.int64()), pa.array(sets, pa.binary()), pa.array(rows, pa.binary()), pa.array(held, pa.binary()),
            pa.array(few, pa.list_(pa.int64()))]


def buckets(classes: DataFrame, percent: int) -> DataFrame:
    """(bucket, band, class): one row for each band of each class that has a sketch, and for
    each of the rarest shingles of a class with few."""
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sketch", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)])
    banded = classes.filter("sketch is not null").select(F.posexplode(keys).alias("band", "bucket"), "c")
    # similar sets share ``percent`` percent of either, so not all of the others: any order of
    # the shingles will do, and with the rarest first the buckets are small
    small = classes.filter("few is not null").select("c", "n", F.explode("few").alias("s"))
    common = small.groupBy("s").agg(F.count("*").alias("k"))
    listed = small.join(common, "s").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("ranked"))  # FEW * 4 / 3 at most
    first = F.slice("ranked", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    rare = listed.select("c", F.explode(first).alias("r")).filter("r.k > 1")
    return banded.unionByName(rare.select(F.lit(RARE).alias("band"), F.xxhash64(F.lit(RARE), F.col("r.s")).alias("bucket"), "c"))


def spokes(classes: DataFrame, percent: int) -> DataFrame:
    """(bucket, band, c, centre): in each bucket with several classes, every class but the
    centre. The centre is the bucket's weightiest class: a class's weight is the sum of the
    sizes of its buckets, and the text that others were derived from agrees with each of
    them more than they do with each other, so it weighs most."""
    members = buckets(classes, percent)
    sizes = members.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1")
    met = stored(members.join(sizes, "bucket"), "shared-buckets")
    weights = met.groupBy("c").agg(F.sum("k").alias("weight"))
    weighed = met.drop("k").join(weights, "c")
    centres = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "c")).alias("m")).select("bucket", F.col("m.c").alias("centre"))
    return stored(met.drop("k").join(centres, "bucket").filter("c <> centre"), "spokes")


def sieved(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is in ``wanted``, and a few others: a bitmap of
    ``SIEVE_BITS`` bits over key hashes (4 MB, whatever the tables' sizes) is broadcast, so
    that rows which an exact join will not need are not shuffled for it."""
    hashed = lambda x: x.withColumn("__h", F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS)) + 1)
    bitmaps = (hashed(wanted).groupBy(F.bitmap_bucket_number("__h").alias("__b"))
               .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__h")).alias("__bits")))
    at = F.bitmap_bit_position("__h")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = hashed(df).withColumn("__b", F.bitmap_bucket_number("__h")).join(F.broadcast(bitmaps), "__b")
    return joined.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*[F.col(f"`{c}`") for c in df.columns])


def possible(a: Column, b: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether two sets with these counts can be similar enough."""
    @F.pandas_udf(T.BooleanType())
    def can(x, y, n, m):
        import pandas as pd
        most = np.array([most_shared(v, w) for v, w in zip(x, y)], np.int64)
        return pd.Series(100 * most >= percent * (n.to_numpy() + m.to_numpy() - most), dtype=bool)

    return can(a, b, na, nb)


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t, text): one copy of each wanted text. Each task hands on one copy of a text, so
    many copies don't meet in one task."""
    # an inner join: the optimizer would push a semi-join below the sieve
    return sieved(docs, "t", wanted).groupBy("t").agg(F.first("text").alias("text")).join(wanted.distinct(), "t")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough."""
    ends = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c")))
    side = lambda x: sieved(classes, "c", ends).select(F.col("c").alias(x), F.col("counts").alias(f"s{x}"), F.col("n").alias(f"n{x}"), F.col("t").alias(f"t{x}"))
    # sizes alone rule out pairs whose smaller set is below the threshold's share
    sized = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(sized)
    near = near.filter(possible(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), percent))
    near = stored(near.select("a", "b", "ta", "tb"), "near-pairs")
    if near.isEmpty():
        return near.select("a", "b")
    wanted = near.select(F.col("ta").alias("t")).union(near.select(F.col("tb").alias("t"))).distinct()
    texts = stored(texts_of(docs, wanted), "near-texts")
    both = (near.join(texts.select(F.col("t").alias("tb"), F.col("text").alias("xb")), "tb")
            .join(texts.select(F.col("t").alias("ta"), F.col("text").alias("xa")), "ta")
            .select("a", "b", "ta", "xa", "xb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, known = None, None
        for batch in batches:
            names, keep = batch.column("ta").to_pylist(), []
            for i, name in enumerate(names):
                if name != centre:
                    centre, known = name, shingle_sets(batch.column("xa").slice(i, 1))[0]
                other = shingle_sets(batch.column("xb").slice(i, 1))[0]
                shared = len(np.intersect1d(known, other, assume_unique=True))
                keep.append(100 * shared >= percent * (len(known) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))],
                                             names=["a", "b"])

    return stored(both.mapInArrow(run, "a bigint, b bigint"), "links")


def components(links: DataFrame) -> DataFrame:
    """(c, label): the least class that each linked class can reach. Every round takes
    the least label among the neighbours and then the label of that label."""
    edges = stored(links.select(F.col("a").alias("c"), F.col("b").alias("d")).union(links.select(F.col("b").alias("c"), F.col("a").alias("d")))
                   .filter("c <> d").distinct(), "edges")
    labels = stored(edges.groupBy("c").agg(F.min("d").alias("d")).select("c", F.least("c", "d").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("c").alias("d"), "label"), "d").groupBy("c").agg(F.min("label").alias("seen"))
        step = labels.join(near, "c").select("c", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        above = labels.select(F.col("c").alias("label"), F.col("label").alias("up"))
        step = step.join(above, "label", "left").select("c", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        step = stored(step, "labels")
        labels = step.select("c", "label")
        if step.filter("old <> label").isEmpty():
            return labels


def near_duplicates(df: DataFrame, text: str = "text", id_column: str = "doc_id", carry: Sequence[str] | None = None,
                    percent: int = PERCENT) -> DataFrame:
    """``df``'s ``carry`` columns with ``n_shingles``, ``component_id`` (the least id that
    links reach) and ``kept`` (the row's id is that id)."""
    names = [c for c in (df.columns if carry is None else carry) if c.lower() not in RESULTS]
    content = F.col(f"`{text}`").cast("string")
    key = F.unhex(F.md5(content))
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None).cast("string")
    source = df.select(row.alias("__row"), F.col(f"`{id_column}`").alias("__doc"), key.alias("__t"),
                       F.octet_length(content).alias("__len"), content.alias("__x"))
    prints = stored(map_text(source, "__x", FINGERPRINT, lambda: lambda column: fingerprint(column, percent), carry=source.columns[:-1]),
                    "fingerprints")
    classes = prints.filter("n_shingles > 0").groupBy("__set").agg(
        F.min("__doc").alias("doc"), F.min("__t").alias("t"), F.max("__len").alias("len"), F.first("n_shingles").alias("n"),
        F.first("__sketch").alias("sketch"), F.first("__counts").alias("counts"), F.first("__few").alias("few"))
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    docs = df.select(key.alias("t"), content.alias("text"))

    members = spokes(classes, percent)
    # candidate pairs: every class of a bucket with the bucket's centre
    pairs = stored(members.select(F.least("c", "centre").alias("a"), F.greatest("c", "centre").alias("b")).distinct(), "pairs")
    links = confirmed(pairs, classes, docs, percent)
    labels = components(links)
    more = across(members, labels, classes, docs, percent)
    if not more.isEmpty():
        labels = components(links.union(more))

    groups = classes.select("c", "doc", "__set").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = groups.groupBy("label").agg(F.min("doc").alias("component"))
    final = groups.join(least, "label").select("__set", "component")
    out = prints.join(final, "__set", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("__doc"))
    return out.select(*[F.col("__row")[c].alias(c) for c in names], "n_shingles", component.alias("component_id"),
                      F.col("__doc").eqNullSafe(component).alias("kept"))


def across(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The links between different components of the same bucket."""
    marked = members.select("bucket", "band", "c").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    marked = marked.join(classes.select("c", "len"), "c")
    sizes = marked.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.sum("len").alias("bytes"))
    split = sizes.groupBy("bucket").agg(F.sum("k").alias("size"), F.sum("bytes").alias("bytes"), F.count("*").alias("n"),
                                        F.max(F.struct("k", "label")).alias("m"))
    split = split.filter("n > 1").select("bucket", "size", "bytes", F.col("m.label").alias("most"))
    apart = stored(marked.drop("len").join(split, "bucket"), "apart")
    met = apart.select("c").distinct()
    wanted = sieved(classes, "c", met).select("c", "t", "sketch", "counts").join(met, "c")
    wanted = stored(wanted, "apart-classes")
    full = wanted.join(texts_of(docs, wanted.select("t")), "t").drop("t")

    # as many blocks as keep both the classes and the bytes of each bounded
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))
    rows = apart.withColumn("block", F.pmod(F.xxhash64("c"), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "c",
                       "label", (F.col("label") != F.col("most")).alias("query"), "block")
    pairs = rows.join(full, "c").groupBy("bucket", "i", "j").applyInArrow(lambda t: compared(t, percent), "a bigint, b bigint")
    return stored(pairs, "links")


def compared(group: pa.Table, percent: int) -> pa.Table:
    """The links between the classes of different components in one block pair of a
    bucket. A pair is looked at only in the first band that both share."""
    group = group.combine_chunks().sort_by("c")
    names = group.column("c").to_pylist()
    labels = group.column("label").dictionary_encode().combine_chunks().indices.to_numpy()
    query = group.column("query").to_numpy(zero_copy_only=False)
    block = group.column("block").to_numpy()
    one_block = group.column("i")[0] == group.column("j")[0]
    band = group.column("band")[0].as_py()
    held = group.column("counts").to_pylist()
    # in a bucket of rare shingles every pair is looked at
    codes = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, SLOTS) if band < RARE else None
    hashes, counts = shingle_sets(group.column("text"))
    ends = np.cumsum(counts)
    at = np.arange(len(names))
    found = []
    for k in np.flatnonzero(query):
        other = labels != labels[k]
        if not one_block:
            other &= block != block[k]
        other &= ~query | (at > k)
        other &= 100 * np.minimum(counts, counts[k]) >= percent * np.maximum(counts, counts[k])
        other = np.flatnonzero(other)
        if codes is not None:
            same = codes[other, :BANDS * ROWS] == codes[k, :BANDS * ROWS]
            other = other[same.reshape(len(other), BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
        own = hashes[ends[k] - counts[k]:ends[k]]
        few = counts[other] <= FEW
        # short sets are many and small: all of them in one go
        short = other[few]
        if len(short):
            size = counts[short]
            start = np.cumsum(size) - size
            theirs = hashes[np.repeat(ends[short] - size - start, size) + np.arange(size.sum())]
            both = np.add.reduceat(own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs, start, dtype=np.int64)
            found += [(names[k], names[m]) for m in short[100 * both >= percent * (counts[k] + size - both)]]
        for m in other[~few]:
            most = most_shared(held[k], held[m])
            if 100 * most < percent * (counts[k] + counts[m] - most):
                continue
            both = len(np.intersect1d(own, hashes[ends[m] - counts[m]:ends[m]], assume_unique=True))
            if 100 * both >= percent * (counts[k] + counts[m] - both):
                found.append((names[k], names[m]))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})
