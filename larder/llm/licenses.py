"""License scans as an exact set-similarity join between text blocks and templates.

A template is the set of words of a license statement. A text is cut into blocks of
words, twice as long as the template and half overlapping, so every passage of a
template's length lies whole in some block, wherever its lines break. A block meets a
template if it holds at least ``percent`` percent of the template's words.

The join is exact and looks at few blocks. Tokens are ordered by how often the whole
corpus holds them, rarest first. With ``need`` the least overlap of a template of n words,
a block of m template words that meets it must share a word within the first
n - need + 1 of the template and within its own first m - need + 1 (prefix filter), must
hold need words at all (length filter), and the shared word's places i and j must leave
room: least(i, j) + least(n - i, m - j) >= need (positional filter). Pairs that pass are
compared word by word.

Two passes over the texts: one counts the templates' words over all rows (partial sums,
one row for each word and task), one finds the phrases and the blocks that hold a prefix
word of some template; blocks and templates are joined on (word, block length) as tables.
The row numbers that bring the labels back to their texts are those of a table in the
shared folder, so they do not change when a task runs again.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are
judged one by one; a very long text is read whole; an empty table gives no rows; without
templates the phrases alone decide; a carried column named like a result column gives way
to the result; ties have no influence (labels are sets, the score is a maximum).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.columns import ALNUM, LOWER, Rolling, before, cuts, map_text, small_batches, spans, utf8
from larder.llm.shared import stored

# fixed values: phrases that name a license, and their labels
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# fixed values: wordings of well-known license statements
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
PERCENT = 90

BLOCK_FIELDS = [T.StructField("half", T.LongType()), T.StructField("block", T.LongType()), T.StructField("ranks", T.ArrayType(T.IntegerType()))]
FIELDS = [*[T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")],
          T.StructField("__base", T.ArrayType(T.StringType())), T.StructField("__blocks", T.ArrayType(T.StructType(BLOCK_FIELDS)))]
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def words_of(text: str) -> list[str]:
    """The words of a template or phrase, by the rule of the texts."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends = spans(ALNUM[data], np.array([0, len(data)]))
    return [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist())]


class Template(NamedTuple):
    label: str
    ranks: list[int]   # distinct words, rarest first
    need: int          # least shared words
    half: int          # half a block, in words


def half_block(n_words: int) -> int:
    """The least power of two that is no less than the template's length."""
    return 1 << max(0, n_words - 1).bit_length()


def hashes_of(words: Sequence[str]) -> np.ndarray:
    """The hash that ``Rolling`` gives each word."""
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return Rolling(data).of(np.r_[0, ends[:-1]].astype(np.int64), ends.astype(np.int64))


def _ranks(column: pa.Array, sorted_hashes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's rank in the vocabulary (-1: not in it), and where each text's words begin."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends = spans(ALNUM[data], offsets)
    found = Rolling(data).of(starts, ends)
    at = np.minimum(np.searchsorted(sorted_hashes, found), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == found, ranks[at], -1), before(offsets, starts)


def frequencies(df: DataFrame, text: str, vocabulary: Sequence[str]) -> list[int]:
    """How often all texts together hold each word of the vocabulary."""
    small_batches(df.sparkSession)
    hashes = hashes_of(vocabulary)
    order = np.argsort(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for lo, hi in cuts(batch.column(0), 1 << 20):
                ranks, _ = _ranks(batch.column(0).slice(lo, hi - lo), hashes[order], order)
                total += np.bincount(ranks[ranks >= 0], minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["word", "n"])

    counts = df.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "word bigint, n bigint")
    out = [0] * len(vocabulary)
    for word, n in counts.groupBy("word").agg(F.sum("n")).collect():  # at most one row for each word of the templates
        out[word] = n
    return out


def scanner(templates: Sequence[Template], phrases: Sequence[tuple[list[int], str]], hashes: np.ndarray) -> Callable:
    """A function from a slice of texts to ``FIELDS``. ``hashes[r]`` is the hash of the word of rank r."""
    order = np.argsort(hashes)
    halves = sorted({t.half for t in templates})
    # the words that can open a match, and the least words of a match, for each block length
    opening = {h: np.unique([r for t in templates if t.half == h for r in t.ranks[:len(t.ranks) - t.need + 1]]) for h in halves}
    least = {h: min(t.need for t in templates if t.half == h) for h in halves}

    def places(ranks: np.ndarray, owner: np.ndarray, phrase: list[int]) -> np.ndarray:
        n = len(ranks) - len(phrase) + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        hit = owner[:n] == owner[len(phrase) - 1:]
        for k, r in enumerate(phrase):
            hit &= ranks[k:k + n] == r
        return np.flatnonzero(hit)

    def scan(column: pa.Array) -> list[pa.Array]:
        ranks, word_at = _ranks(column, hashes[order], order)
        n_texts, n_words = len(column), np.diff(word_at)
        owner = np.repeat(np.arange(n_texts), n_words)
        n_base, first, last = np.zeros(n_texts, np.int64), np.full(n_texts, np.iinfo(np.int64).max), np.full(n_texts, -1)
        labels: list[set] = [set() for _ in range(n_texts)]
        for phrase, label in phrases:
            at = places(ranks, owner, phrase)
            np.add.at(n_base, owner[at], 1)
            np.minimum.at(first, owner[at], at - word_at[owner[at]])
            np.maximum.at(last, owner[at], at - word_at[owner[at]])
            for i in np.unique(owner[at]).tolist():
                labels[i].add(label)
        blocks: list[list] = [[] for _ in range(n_texts)]
        known = np.flatnonzero(ranks >= 0)
        for h in halves:
            at = known[np.isin(ranks[known], opening[h])]
            own, number = owner[at], (at - word_at[owner[at]]) // h
            # a word lies in the block that begins in its half and in the one before
            both = np.concatenate([np.stack([own, number], 1), np.stack([own, number - 1], 1)[number > 0]])
            for i, b in np.unique(both, axis=0).tolist():
                lo = word_at[i] + b * h
                hi = min(lo + 2 * h, word_at[i + 1])
                inside = np.unique(ranks[known[np.searchsorted(known, lo):np.searchsorted(known, hi)]])
                if len(inside) >= least[h]:
                    blocks[i].append({"half": h, "block": b, "ranks": inside.tolist()})
        none = n_base == 0
        return [pa.array(n_words, pa.int64()), pa.array(n_base, pa.int64()), pa.array(first, pa.int64(), mask=none),
                pa.array(last, pa.int64(), mask=none), pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                pa.array(blocks, pa.list_(pa.struct([("half", pa.int64()), ("block", pa.int64()), ("ranks", pa.list_(pa.int32()))])))]

    return scan


def matches(spark: SparkSession, blocks: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """The (block, template) pairs that meet the threshold: ``blocks``' columns but the
    words, with ``label`` and the share ``found`` of the template."""
    listed = [(r, t.half, i, len(t.ranks), t.need, t.label, t.ranks)
              for t in templates for i, r in enumerate(t.ranks[:len(t.ranks) - t.need + 1])]
    kinds = [("word", pa.int32()), ("half", pa.int64()), ("i", pa.int32()), ("n", pa.int32()), ("need", pa.int32()),
             ("label", pa.string()), ("template", pa.list_(pa.int32()))]
    # an Arrow table: the optimizer knows its size and broadcasts it if it is small
    index = spark.createDataFrame(pa.table([pa.array([x[k] for x in listed], kind) for k, (_, kind) in enumerate(kinds)],
                                           names=[name for name, _ in kinds]))
    opened = blocks.withColumn("m", F.size("ranks")).select("*", F.posexplode("ranks").alias("j", "word"))
    joined = opened.join(index, ["word", "half"])
    long_enough = F.col("m") >= F.col("need")
    in_prefix = F.col("j") <= F.col("m") - F.col("need")
    room = F.least("i", "j") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= F.col("need")
    shared = joined.filter(long_enough & in_prefix & room).withColumn("both", F.size(F.array_intersect("ranks", "template")))
    return shared.filter("both >= need").withColumn("found", F.col("both") / F.col("n")).drop(
        "word", "half", "i", "j", "m", "n", "need", "template", "both", "ranks")


def scan_licenses(df: DataFrame, text: str = "text", carry: Sequence[str] | None = None,
                  templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), phrases: Sequence[tuple[str, str]] = tuple(PHRASES),
                  percent: int = PERCENT) -> DataFrame:
    """``df``'s ``carry`` columns with the words, the phrase places, the labels of phrases
    (``base_labels``), those together with the labels of met templates (``labels``), and
    ``score``: the largest share of a template that a block holds, at or above the
    threshold (1 for a phrase, 0 if nothing is found)."""
    spark = df.sparkSession
    names = [c for c in (df.columns if carry is None else carry) if c.lower() not in RESULTS]
    wordings = [(label, words_of(wording)) for label, wording in templates]
    wordings = [(label, words) for label, words in wordings if words]
    named = [(words_of(phrase), label) for phrase, label in phrases]
    vocabulary = sorted({w for _, words in wordings for w in words} | {w for words, _ in named for w in words})
    if not vocabulary:
        raise ValueError("neither a template nor a phrase has a word")
    counted = frequencies(df, text, vocabulary)
    vocabulary = [w for _, w in sorted(zip(counted, vocabulary))]
    rank = {w: r for r, w in enumerate(vocabulary)}
    sets = [Template(label, own := sorted({rank[w] for w in words}), -(-percent * len(own) // 100), half_block(len(words)))
            for label, words in wordings]
    scan = scanner(sets, [([rank[w] for w in words], label) for words, label in named], hashes_of(vocabulary))

    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(f"`{text}`").alias("__x")) if names else \
        df.select(F.lit(None).cast("string").alias("__row"), F.col(f"`{text}`").alias("__x"))
    rows = map_text(inner, "__x", FIELDS, lambda: scan, carry=["__row"])
    rows = stored(rows.withColumn("__id", F.monotonically_increasing_id()), "license-rows")
    blocks = rows.filter(F.size("__blocks") > 0).select("__id", F.explode("__blocks").alias("b")).select("__id", "b.*")
    found = matches(spark, blocks.drop("block"), sets).groupBy("__id").agg(
        F.collect_set("label").alias("__met"), F.max("found").alias("__found"))  # at most one entry for each label
    out = rows.join(found, "__id", "left")
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    met = F.coalesce("__met", F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("__found", F.lit(0.0)))
    return out.select(*([F.col("__row")[c].alias(c) for c in names]), "n_words", "n_base", "first_word", "last_word",
                      listed(F.col("__base")).alias("base_labels"), listed(F.concat("__base", met)).alias("labels"), score.alias("score"))
