"""Sequence packing by first-fit decreasing.

Documents become token ids, are cut at the sequence length into pieces, and the pieces
go to randomised groups of bounded size. Each group is packed on its own: the longest
piece first, into the first sequence that has room, found in a tournament tree of the
sequences' free capacities. Groups, not the table, bound memory; the loss to packing
groups apart is below one sequence a group.

Defined cases: a null or empty text is its end id alone; repeated rows and null ids are
packed like any other row; a text of any length is cut, never dropped; the string of an
added token stands for that token's id; ties in length are broken by row and start; an empty table gives no rows; carried columns that clash
with result columns give way to them.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.columns import SLICE_BYTES, cuts, free_name, set_aside, small_batches
from larder.llm.shared import stored

CAPACITY = 2048
END_ID = 1
GROUP_PIECES = 4096
VOCABULARY = "byte_bpe_50k.json"
PIECE = [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
         T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType())]
#: A pre-token this long is left to the tokenizers library, whose merges stay linear on it.
LONG_RUN = re.compile(r"\S{512}|\s{512}")


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare file name is one of the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str, special_as_text: bool = True):
    """A function from texts to token ids: those of the tokenizers library for this
    vocabulary. The strings of its added tokens are ordinary text, or else, as the
    library has it by default, stand for their own ids. Texts without them and without
    very long runs go through tiktoken built from the same file, five times as fast."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary_path(vocabulary)
    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = special_as_text
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    vocab, added = described["model"]["vocab"], [t["content"] for t in described.get("added_tokens") or ()]
    # the printable stand-ins that byte-level vocabularies write bytes with
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token)}
    ranks = {token: i for token, i in ranks.items() if token != b"<|endoftext|>"}
    own_id = [] if special_as_text else added
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if LONG_RUN.search(text) or any(x in text for x in own_id):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(df: DataFrame, text: str = "text", carry: Sequence[str] | None = None, capacity: int = CAPACITY,
           vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: start, length, CRC-32 of the ids,
    tokens of the document, and the ids if asked for. Stored, so rows keep their numbers."""
    small_batches(df.sparkSession)
    fields = [*PIECE, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])]
    taken = {f.name for f in fields} | {"sequence_id", "offset"}
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in taken]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(free_name("__text__", kept)))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, special_as_text=False)
        for batch in batches:
            for lo, hi in cuts(batch.column(len(kept)), SLICE_BYTES):
                rows, owner = [], []
                for i, x in enumerate(batch.column(len(kept)).slice(lo, hi - lo).to_pylist(), lo):
                    ids = np.array([*(encode(x) if x else ()), END_ID], "<u4")
                    for start in range(0, len(ids), capacity):
                        part = ids[start:start + capacity]
                        row = (start, len(part), zlib.crc32(part.tobytes()), len(ids))
                        rows.append((*row, part.astype(np.int32)) if with_ids else row)
                        owner.append(i)
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(len(kept))],
                                                  *[pa.array(x, t) for x, t in zip(zip(*rows), types)]], names=schema.names)

    return stored(source.mapInArrow(run, schema), "pieces")


def first_fit(lengths: Sequence[int], capacity: int) -> list[int]:
    """The bin of each item, in the order given: the first bin with room."""
    width = 1
    while width < len(lengths):
        width *= 2
    # free[1] is the root; the leaves free[width:] are the bins, all empty at first
    free = [capacity] * (2 * width)
    out = []
    for length in lengths:
        at = 1
        while at < width:
            at *= 2
            if free[at] < length:
                at += 1
        out.append(at - width)
        free[at] -= length
        while at > 1:
            at //= 2
            left, right = free[2 * at], free[2 * at + 1]
            free[at] = left if left > right else right
    return out


def pack_group(group: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """``sequence`` and ``offset`` for the pieces of one group."""
    group = group.sort_values(["length", "__row", "start"], ascending=[False, True, True], kind="stable")
    bins = np.array(first_fit(group["length"].tolist(), capacity), np.int64)
    lengths = group["length"].to_numpy()
    order = np.argsort(bins, kind="stable")
    ranked = lengths[order]
    before = np.cumsum(ranked) - ranked
    first = np.r_[True, bins[order][1:] != bins[order][:-1]]
    offset = np.empty(len(group), np.int64)
    offset[order] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(bins)]))
    return group.assign(sequence_id=(group["__group"].to_numpy(np.int64) << 24) | bins, offset=offset)


def pack(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with ``sequence_id`` and the gapless ``offset`` in their sequence. The
    number of groups follows the number of pieces."""
    groups = max(1, -(-parts.count() // group_pieces))
    parts, back = set_aside(parts, ("__row", "__group"))
    rows = parts.withColumn("__row", F.monotonically_increasing_id())
    rows = rows.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    columns = schema.names

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pack_group(group, capacity)[columns]

    return rows.groupBy("__group").applyInPandas(run, schema).drop("__row", "__group").withColumnsRenamed(back)
