"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in
numpy measure how many characters of a text lie inside n-grams or lines that the same
text holds more than once.

Defined cases: a null or empty text has no words and fails the base rule; very long
texts are measured whole (a slice of their own); repeated rows are judged one by one;
an empty table gives an empty result; a carried column named like a result column gives
way to the result. Two different n-grams count as equal only if their 64-bit hashes
collide.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larder.llm.columns import SPACED, Rolling, before, covered, map_text, mix, per_text, spans, utf8, windows

#: n-gram length -> most percent of word characters inside repeated n-grams of that length.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Most percent of word characters inside lines that occur more than once.
LINE_LIMIT = 20
BASE_NGRAM = 3
MIN_WORDS = 50
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def fields(limits: dict[int, int]) -> list[T.StructField]:
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
             *[f"dup_{n}gram_chars" for n in limits]]
    return [*[T.StructField(c, T.LongType()) for c in longs],
            *[T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]]


def quality(df: DataFrame, text: str = "text", carry: Sequence[str] | None = None,
            limits: dict[int, int] = NGRAM_LIMITS, line_limit: int = LINE_LIMIT) -> DataFrame:
    """``df`` with the measures of every text and the verdict ``kept``: the base rule
    holds, at most ``limits[n]`` percent of the word characters lie inside repeated
    n-grams for each n, and at most ``line_limit`` percent inside repeated lines."""
    return map_text(df, text, fields(limits), lambda: lambda column: measure(column, limits, line_limit), carry)


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once; which of them are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    often, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    often[order], later[order] = same[1:] | same[:-1], same[:-1]
    return often, later


def measure(column: pa.Array, limits: dict[int, int], line_limit: int) -> list[pa.Array]:
    data, offsets = utf8(column)
    n_texts = len(column)
    rolling = Rolling(data)
    starts, ends = spans(SPACED[data], offsets)
    word_at = before(offsets, starts)
    n_words = np.diff(word_at)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    word_chars = per_text(chars, word_at)
    owner = np.repeat(np.arange(n_texts), n_words)
    hashes = rolling.of(starts, ends)
    salt = mix(np.arange(1, n_texts + 1, dtype=np.uint64))

    def repeated(n: int) -> np.ndarray:
        """Which words lie in an n-gram that their text holds at least twice."""
        if len(hashes) < n:
            return np.zeros(len(hashes), bool)
        inside = np.flatnonzero(owner[:len(hashes) - n + 1] == owner[n - 1:])
        often, _ = _twice(windows(hashes, n)[inside] ^ salt[owner[inside]])
        return covered(len(hashes), inside[often], n)

    # lines: cut after every \n and at text borders
    line_starts, line_ends = spans(data != 0x0A, offsets)
    line_words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    worded = line_words > 0
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_at = before(offsets, line_starts)
    line_owner = np.repeat(np.arange(n_texts), np.diff(line_at))
    often, later = _twice(rolling.of(line_starts, line_ends) ^ salt[line_owner])
    char_sum = np.concatenate([[0], np.cumsum(chars)])
    line_chars = char_sum[np.searchsorted(starts, line_ends)] - char_sum[np.searchsorted(starts, line_starts)]

    symbol_sum = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    n_repeat = per_text(repeated(BASE_NGRAM), word_at)
    dup_lines = per_text(np.where(often, line_chars, 0), line_at)
    dup_grams = {n: per_text(np.where(repeated(n), chars, 0), word_at) for n in limits}
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
    kept = ~failed & (100 * dup_lines <= line_limit * word_chars)
    for n, most in limits.items():
        kept &= 100 * dup_grams[n] <= most * word_chars
    longs = [n_words, word_chars, np.diff(symbol_sum[offsets]), per_text(later, line_at), n_repeat, dup_lines,
             *dup_grams.values()]
    return [*[pa.array(x, pa.int64()) for x in longs], pa.array(failed), pa.array(kept)]
