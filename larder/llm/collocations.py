"""Phrase collocation mining with weighted acyclic automata.

Texts are cut into pieces and words. A first pass counts words by a 64-bit hash; the hashes
with ``least`` places or more set bits of a bitmap of ``SIEVE_BITS`` bits (4 MB in every
task, whatever the corpus). A word without its bit is in no frequent phrase, so it ends a
piece as a full stop does; a word that has the bit by accident costs time and nothing else.

At every other word begins a sequence of up to four words, shorter where its piece ends. A
task sorts the sequences of a shard (some millions of
words of one language), sums them and builds a count automaton for each prefix range, a
stretch of the order of all sequences. The automata of a range meet in one task, which
unites them, adds their weights and reads the count of every phrase off the prefixes:
the weight of an arc is the number of places where the words up to it stand. Prefixes cut
by a range's border are the border's own prefixes; each range hands on its part of them
and the parts are added up.

Frequent phrases (``least`` places or more) go on. The two parts of every cut are phrases
too: buckets of candidates ask for their parts, each part once a bucket, and compose
them with an automaton of the answers.

The borders come from a sample of documents of about ``SAMPLE_BYTES`` bytes, which only
decides how even the ranges are, never what is counted; there are at most ``MAX_RANGES`` of
them (4 MB or so in every task). A range has about ``RANGE_BYTES`` bytes of text up to
1 TB of input; beyond, it grows with the input and wants workers of more memory.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows
count each; a long text is taken in stretches that overlap by three words; an empty table
or one without frequent phrases gives no rows; ties go by count and then by the phrase's
UTF-8 bytes; extra columns are not read. Scores are Python integers, exact at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.automata import DEPTH, Automaton, cut, labels, summed, union
from larder.llm.columns import Rolling, mix, small_batches
from larder.llm.divergence import runs
from larder.llm.ranked import first_per_group
from larder.llm.shared import stored

LEAST = 30
TOP = 2000
#: A phrase goes if a longer one that holds it has this percent of its places.
ABSORBED = 80
SCALE = 2_000_000
#: Words of a shard, and of all languages together that a task holds.
SHARD_WORDS = 500_000
HELD_WORDS = 1_000_000
RANGE_BYTES = 4 << 20
MAX_RANGES = 1 << 16
SAMPLE_BYTES = 8 << 20
#: One in so many of the sample's sequences goes to the driver.
SAMPLE_STEP = 16
SIEVE_BITS = 1 << 25
BUCKET_ROWS = 50_000
#: A-Z lowered; the ends of pieces become a byte that no UTF-8 text holds.
BORDER = b"\xff"
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


class Numbers(dict):
    """A number for each new key."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def word_numbers(data: bytes, numbers: Numbers) -> np.ndarray:
    """The words of a text as numbers, 0 where a piece ends."""
    found = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
             for words in runs(data.translate(TABLE).replace(BORDER, b" \xff "))]
    return np.concatenate([*found, np.zeros(1, np.int32)])


def hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """A hash for each word of a language."""
    ends = np.cumsum([len(w) for w in [lang.encode(), *words]])
    found = Rolling(np.frombuffer(b"".join([lang.encode(), *words]), np.uint8)).of(np.r_[0, ends[:-1]], ends)
    return mix(found[1:] ^ mix(found[:1] + np.uint64(1)))


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Numbers, np.ndarray, int]]:
    """One shard after another: the language, its words' numbers, the texts as numbers, and
    at how many of the first places a sequence may begin (a long text goes on behind)."""
    held: dict[str, tuple[Numbers, list]] = {}
    sizes: dict[str, int] = {}

    def build(lang: str):
        numbers, texts = held.pop(lang)
        return lang, numbers, np.concatenate(texts), sizes.pop(lang)

    for batch in batches:
        texts = batch.column(1)
        for i, lang in enumerate(batch.column(0).to_pylist()):
            data = texts[i].as_py()
            if not data:
                continue
            if len(data) > SHARD_WORDS:  # a shard or more of its own
                numbers = Numbers({BORDER: 0})
                stream = word_numbers(data, numbers)
                for lo in range(0, len(stream), SHARD_WORDS):
                    yield lang, numbers, stream[lo:lo + SHARD_WORDS + DEPTH - 1], min(SHARD_WORDS, len(stream) - lo)
                continue
            if lang not in held:
                held[lang], sizes[lang] = (Numbers({BORDER: 0}), []), 0
            numbers, own = held[lang]
            own.append(word_numbers(data, numbers))
            sizes[lang] += len(own[-1])
            if sizes[lang] >= SHARD_WORDS:
                yield build(lang)
            elif sum(sizes.values()) >= HELD_WORDS:
                yield build(max(sizes, key=sizes.get))
    for lang in list(held):
        yield build(lang)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, lang, n): the places of each word's hash, and without a word all places."""
    for lang, numbers, stream, begins in shards(batches):
        counts = np.bincount(stream[:begins], minlength=len(numbers))
        counts[0] = 0
        seen = np.flatnonzero(counts)
        words = list(numbers)
        yield pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array(hashes(lang, [words[k] for k in seen.tolist()]).view(np.int64)), pa.array([None], pa.int64())]),
            pa.concat_arrays([pa.nulls(len(seen), pa.string()), pa.array([lang], pa.string())]),
            pa.array(np.r_[counts[seen], counts.sum()], pa.int64())], names=["word", "lang", "n"])


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(word, lang, n): the hashes with ``least`` places or more, and each language's words."""
    counts = docs.mapInArrow(_word_counts, "word bigint, lang string, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    return stored(counts.filter(F.col("word").isNull() | (F.col("n") >= least)), "word-counts")


class Sieve(NamedTuple):
    """Which words may be frequent."""

    bits: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> Sieve:
        bit = F.pmod("word", F.lit(SIEVE_BITS)) + 1
        maps = (counts.filter(F.col("word").isNotNull()).groupBy(F.bitmap_bucket_number(bit).alias("at"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")))
        bits = np.zeros(SIEVE_BITS // 8, np.uint8)
        for row in maps.collect():  # SIEVE_BITS / 32,768 rows of 4 KB at most
            part = np.frombuffer(row["bits"], np.uint8)
            bits[(row["at"] - 1) * len(part):row["at"] * len(part)] = part
        return cls(bits)

    def passes(self, found: np.ndarray) -> np.ndarray:
        at = (found & np.uint64(SIEVE_BITS - 1)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def sequences(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
        """For each shard: the language, the words that pass, sorted, and the different
        sequences of them with their counts."""
        for lang, numbers, stream, begins in shards(batches):
            words = np.array(list(numbers), object)
            pick = np.flatnonzero(self.passes(hashes(lang, words.tolist())))
            pick = np.array(sorted((k for k in pick.tolist() if k), key=words.__getitem__), np.int64)
            label = np.zeros(len(words), np.int32)
            label[pick] = np.arange(1, len(pick) + 1)
            stream = np.concatenate([label[stream], np.zeros(DEPTH - 1, np.int32)])
            at = np.flatnonzero(stream[:begins])
            paths = np.zeros((len(at), DEPTH), np.int32)
            for k in range(DEPTH):
                paths[:, k] = stream[at + k] * (paths[:, k - 1] > 0 if k else 1)
            yield lang, words[pick].tolist(), *summed(paths, np.ones(len(paths), np.int64))


def borders(docs: DataFrame, sieve: Sieve) -> dict[str, list[tuple[bytes, ...]]]:
    """The sequences at which each language's ranges begin, but for the first."""
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, paths, _ in sieve.sequences(batches):
            rows = [b" ".join(words[k - 1] for k in path if k).decode() for path in paths[::SAMPLE_STEP].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.string())], names=["lang", "phrase"])

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MAX_RANGES, -(-total // RANGE_BYTES))
    if n <= 1:
        return {}
    rows = docs.sample(min(1.0, SAMPLE_BYTES / total), seed=13).mapInArrow(sampled, "lang string, phrase string").collect()
    ordered = sorted((lang, tuple(phrase.encode().split(b" "))) for lang, phrase in rows)
    out: dict[str, list] = {}
    for k in range(1, n):
        lang, at = ordered[k * len(ordered) // n] if ordered else ("", ())
        own = out.setdefault(lang, [])
        if not own or own[-1] != at:
            own.append(at)
    return out


class Ranges(NamedTuple):
    """The work of the tasks that make and unite automata."""

    sieve: Sieve
    starts: dict[str, list[tuple[bytes, ...]]]
    least: int

    def automata(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, range, automaton)"""
        for lang, words, paths, counts in self.sieve.sequences(batches):
            ends = [0, *cut(words, paths, self.starts.get(lang, [])), len(paths)]
            for k, (lo, hi) in enumerate(zip(ends, ends[1:])):
                if lo == hi:
                    continue
                own = paths[lo:hi]
                used = np.unique(own)
                used = used[used > 0]
                label = np.zeros(len(words) + 1, np.int32)
                label[used] = np.arange(1, len(used) + 1)
                made = Automaton.from_sorted([words[w - 1] for w in used.tolist()], label[own], counts[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([k], pa.int32()),
                                                  pa.array([made.dumps()], pa.binary())], names=["lang", "range", "automaton"])

    def phrases(self, group: pa.Table) -> pa.Table:
        """(lang, phrase, n): the frequent phrases of a range, and its part of the prefixes
        of its borders."""
        lang, k = group.column("lang")[0].as_py(), group.column("range")[0].as_py()
        united = union([Automaton.loads(x.as_py()) for x in group.column("automaton")])
        starts = self.starts.get(lang, [])
        shared = {at[:n] for at in starts[max(k - 1, 0):k + 1] for n in range(1, len(at) + 1)}
        rows: list[tuple] = []
        for d, paths, weight, _ in united.prefixes():
            often = weight >= self.least
            border = labels(united.words, [x for x in shared if len(x) == d + 1])[:, :d + 1]
            for path in border:
                often |= (paths[:, :d + 1] == path).all(axis=1)
            chosen = paths[often][:, :d + 1].tolist()
            rows += [(b" ".join([united.words[w - 1] for w in path]).decode(), n) for path, n in zip(chosen, weight[often].tolist())]
        return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "phrase": pa.array([p for p, _ in rows], pa.string()),
                         "n": pa.array([n for _, n in rows], pa.int64())})


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, phrase, n): the number of places of every phrase of one to four words that
    has at least ``least`` of them; rows without a phrase have the number of all words."""
    small_batches(df.sparkSession)
    docs = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    words = word_counts(docs, least)
    sieve = Sieve.of(words)
    work = Ranges(sieve, borders(docs, sieve), least)
    made = docs.mapInArrow(lambda batches: work.automata(batches), "lang string, range int, automaton binary")
    parts = made.groupBy("lang", "range").applyInArrow(lambda group: work.phrases(group), "lang string, phrase string, n bigint")
    counted = parts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    totals = words.filter(F.col("word").isNull()).select("lang", F.lit(None).cast("string").alias("phrase"), "n")
    return stored(counted.unionByName(totals), "phrase-counts")


def scored(candidates: pa.Table, answers: pa.Table) -> pa.Table:
    """The lowest-scoring cut of each candidate of a bucket: its parts, in their order,
    composed with an automaton of the bucket's answers."""
    langs = candidates.column("lang").to_pylist()
    phrases, counts = candidates.column("phrase").to_pylist(), candidates.column("a").to_pylist()
    split = [p.encode().split(b" ") for p in phrases]
    best: list = [None] * len(phrases)
    for lang in set(langs):
        known = [(p.encode().split(b" "), n) for o, p, n in zip(*(answers.column(c).to_pylist() for c in ("of", "part", "places"))) if o == lang]
        words = sorted({w for p, _ in known for w in p})
        listed = labels(words, [p for p, _ in known])
        automaton = Automaton.from_sorted(words, *summed(listed, np.array([n for _, n in known], np.int64)))
        own = [i for i, o in enumerate(langs) if o == lang]
        cuts = [(i, k) for i in own for k in range(1, len(split[i]))]
        left = automaton.compose(labels(words, [split[i][:k] for i, k in cuts])).tolist()
        right = automaton.compose(labels(words, [split[i][k:] for i, k in cuts])).tolist()
        for (i, _), l, r in zip(cuts, left, right):
            score = SCALE * counts[i] // (l + r)
            if best[i] is None or score < best[i][2]:  # the first of equal cuts stays
                best[i] = (l, r, score)
    l, r, score = zip(*best) if best else ((), (), ())
    return pa.table({"lang": candidates.column("lang"), "phrase": candidates.column("phrase"), "a": candidates.column("a"),
                     "l": pa.array(l, pa.int64()), "r": pa.array(r, pa.int64()), "score": pa.array(score, pa.int64())})


def _parts(first: int, last: str) -> str:
    """The contiguous parts of column ``w`` of ``first`` to ``last`` words, as SQL."""
    return (f"flatten(transform(sequence({first}, greatest({first}, {last})), m -> transform(sequence(1, greatest(1, size(w) - m + 1)), "
            f"s -> array_join(slice(w, s, m), ' '))))")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two
    to four words that no longer phrase absorbs, by the score of their weakest cut."""
    counts = phrase_counts(df, text, lang, least)
    totals = counts.filter("phrase is null").select("lang", F.col("n").alias("total"))
    known = counts.filter("phrase is not null")
    buckets = max(1, known.count() // BUCKET_ROWS)
    candidates = (known.withColumn("w", F.split("phrase", " ", -1)).filter("size(w) > 1")
                  .withColumn("bucket", F.pmod(F.xxhash64("lang", "phrase"), F.lit(buckets))))

    ends = "transform(sequence(1, size(w) - 1), k -> array(array_join(slice(w, 1, k), ' '), array_join(slice(w, k + 1, size(w) - k), ' ')))"
    asked = candidates.select("bucket", "lang", F.explode(F.expr(f"flatten({ends})")).alias("phrase")).distinct()
    answers = asked.join(known, ["lang", "phrase"]).select(
        F.col("bucket").alias("to"), F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("n").alias("places"))
    cuts = (candidates.select("bucket", "lang", "phrase", F.col("n").alias("a")).groupBy("bucket").cogroup(answers.groupBy("to"))
            .applyInArrow(scored, "lang string, phrase string, a bigint, l bigint, r bigint, score bigint"))

    inner = candidates.filter("size(w) > 2").select("lang", F.explode(F.expr(_parts(2, "size(w) - 1"))).alias("phrase"), "n")
    absorbing = inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    free = cuts.join(absorbing, ["lang", "phrase"], "left").filter(f"most is null or 100 * most < {ABSORBED} * a")
    ranked = first_per_group(free, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], "phrase", top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r",
                                              F.col("total").alias("n"), "score")
