"""Language identification by interpolated Kneser-Ney character models.

Texts are reduced to lower-case letters with one separator between runs. Every language
gets a character model of order ``ORDER`` with interpolated Kneser-Ney smoothing. The
models of all languages share sorted arrays of n-gram hashes (one array an order), with
one row of log-probabilities per n-gram and a column per language; a table over the
leading hash bits starts each search close to its end. The language of a text is the one
of lowest cross-entropy per character.

The models are fitted on a sample of labelled rows that is bounded for each language
(``SAMPLE_CHARS``, ``SAMPLE_DOCS``), chosen by a hash of the text; part of it is kept out
of the counts and calibrates rejection: a prediction is rejected if its cross-entropy
lies ``REJECT_SIGMA`` deviations above what texts of that language and length have, and
its model tells it no better than a uniform guess over that language's own letters would,
or by ``GUESS_MARGIN`` nats worse than the language's mean.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and is
rejected; rows without a label are not learned from; without any labelled row every text
is ``und``; ties go to the first language by name; very long texts are scored whole;
repeated rows get equal answers; columns that clash with result columns give way to them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.columns import SLICE_BYTES, cuts, map_text, mix, small_batches

ORDER = 4
DISCOUNT = 0.75
SAMPLE_CHARS = 4_000_000
SAMPLE_DOCS = 4_000
#: Most labels that a model is fitted for.
MOST_LANGUAGES = 1_000
CALIBRATION_SHARE = 5  # one sampled row in so many calibrates rejection
REJECT_SIGMA = 4.0
OWN_LETTERS = 0.999  # a language's own letters make up this share of its letters
GUESS_MARGIN = 2.0
SCORE_CHARS = 40
UNDETERMINED = "und"
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
          T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]

SEPARATOR, EDGE, UNKNOWN = 0, 1, 2


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point the lower-case letter it stands for, 0 for anything else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols(texts: Sequence[str | None], symbol_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of symbols, each opened by ``ORDER - 1`` edge symbols, and
    where each begins. Runs of separators become one."""
    texts = [x or "" for x in texts]
    pad = ORDER - 1
    lengths = np.array([len(x) + pad for x in texts], np.int64)
    points = np.frombuffer(("\0" * pad + ("\0" * pad).join(texts)).encode("utf-32-le"), np.uint32)
    out = symbol_of[points]
    begin = np.cumsum(lengths) - lengths
    for k in range(pad):
        out[begin + k] = EDGE
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != SEPARATOR) | ((out[:-1] != SEPARATOR) & (out[:-1] != EDGE))
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[begin]


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` symbols that end at each position from ``ORDER - 1`` on."""
    m = len(codes) - ORDER + 1
    h = np.zeros(m, np.uint64)
    for k in range(ORDER - n, ORDER):
        h = (h + codes[k:k + m] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h + np.uint64(n))


class Sorted:
    """A sorted array of hashes with a table over their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.concatenate([keys, [np.uint64(0xFFFFFFFFFFFFFFFF)]])
        self.bits = max(1, int(len(keys)).bit_length())
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.start = np.searchsorted(keys, edges).astype(np.int32)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The row of each value, or -1."""
        at = self.start[(values >> np.uint64(64 - self.bits)).astype(np.int64)]
        late = np.flatnonzero(self.keys[at] < values)
        while len(late):
            at[late] += 1
            late = late[self.keys[at[late]] < values[late]]
        at[self.keys[at] != values] = -1
        return at


@dataclass
class Model:
    """The models of all languages; ``limits`` holds mean, and the length-free and
    per-character part of the variance of each language's cross-entropy, ``guesses`` the
    cross-entropy of a uniform guess over its own letters."""

    languages: list[str]
    alphabet: np.ndarray
    tables: list[Sorted] = field(default_factory=list)
    scores: list[np.ndarray] = field(default_factory=list)
    contexts: list[Sorted] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    limits: np.ndarray | None = None
    guesses: np.ndarray | None = None

    @functools.cached_property
    def symbol_of(self) -> np.ndarray:
        """The symbol of every code point."""
        folded = letters()
        ranked = np.minimum(np.searchsorted(self.alphabet, folded), max(0, len(self.alphabet) - 1))
        known = self.alphabet[ranked] == folded if len(self.alphabet) else np.zeros(len(folded), bool)
        return np.where(folded == 0, SEPARATOR, np.where(known, ranked + UNKNOWN + 1, UNKNOWN)).astype(np.uint64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "symbol_of"}

    def entropies(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy (nats a character) of each text under each language, its
        characters, and whether it has a letter."""
        codes, begin = symbols(texts, self.symbol_of)
        n_languages = len(self.languages)
        if len(codes) < ORDER:
            return np.zeros((len(texts), n_languages)), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        scored = codes[ORDER - 1:] != EDGE
        total = np.zeros((len(scored), n_languages), np.float32)
        todo = np.flatnonzero(scored)
        for n in range(ORDER, 0, -1):
            row = self.tables[n - 1].find(grams(codes, n)[todo])
            hit = row >= 0
            total[todo[hit]] += self.scores[n - 1][row[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if n > 1:
                context = self.contexts[n - 1].find(self._context(codes, n)[todo])
                seen = context >= 0
                total[todo[seen]] += self.backoff[n - 1][context[seen]]
        if len(todo):
            total[todo] += np.float32(-np.log(len(self.alphabet) + 2))
        ends = np.append(begin[1:], len(codes))
        sums = np.concatenate([np.zeros((1, n_languages)), np.cumsum(total, axis=0, dtype=np.float64)])
        counts = ends - begin - (ORDER - 1)
        # position i of ``total`` is symbol i + ORDER - 1
        h = -(sums[ends - ORDER + 1] - sums[begin]) / np.maximum(counts, 1)[:, None]
        letters_in = np.concatenate([[0], np.cumsum(codes > EDGE)])
        return h, counts, letters_in[ends] > letters_in[begin]

    @staticmethod
    def _context(codes: np.ndarray, n: int) -> np.ndarray:
        """The hash of the ``n - 1`` symbols before each position."""
        m = len(codes) - ORDER + 1
        h = np.zeros(m, np.uint64)
        for k in range(ORDER - n, ORDER - 1):
            h = (h + codes[k:k + m] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return mix(h + np.uint64(n - 1))

    def predict(self, texts: Sequence[str | None]) -> list[pa.Array]:
        n = len(texts)
        if not self.languages:
            return [pa.array([UNDETERMINED] * n), pa.array([0.0] * n), pa.array([None] * n, pa.float64()), pa.array([True] * n)]
        h, counts, worded = self.entropies(texts)
        best = np.argmin(h, axis=1)
        least = h[np.arange(n), best]
        weight = np.exp(-(h - least[:, None]) * np.minimum(np.maximum(counts, 1), SCORE_CHARS)[:, None])
        score = np.where(worded, 1 / weight.sum(axis=1), 0.0)
        mean, fixed, per_char = self.limits[best].T
        floor = np.minimum(self.guesses[best], mean + GUESS_MARGIN)
        limit = np.maximum(mean + REJECT_SIGMA * np.sqrt(fixed + per_char / np.maximum(counts, 1)), floor)
        names = np.array(self.languages, object)
        return [pa.array(np.where(worded, names[best], UNDETERMINED), pa.string()), pa.array(score),
                pa.array(np.where(worded, least, np.nan), from_pandas=True), pa.array(~worded | (least > limit))]


def _symbol_grams(codes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Each ``n``-gram of symbols as one exact number in the given base."""
    m = len(codes) - n + 1
    out = np.zeros(max(0, m), object if base ** n >= 1 << 63 else np.int64)
    for k in range(n):
        out = out * base + codes[k:k + m]
    return out


def fit(counts: pd.DataFrame) -> Model:
    """The models from counts of ``ORDER``-grams (columns lang, gram, n; a gram is a
    string of folded letters, ``\\0`` for a separator and ``\\1`` for a text's edge)."""
    languages = sorted(counts["lang"].unique())
    points = np.frombuffer("".join(counts["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    alphabet = np.unique(points[points > 1])
    model = Model(languages, alphabet)
    # symbols of each n-gram, padded in front to ORDER columns
    rows = np.where(points <= 1, points, np.searchsorted(alphabet, points) + UNKNOWN + 1).astype(np.uint64)
    lang = np.searchsorted(languages, counts["lang"].to_numpy())
    weight = counts["n"].to_numpy(np.float64)
    model.guesses = np.array([_guess(rows[lang == k, -1], weight[lang == k]) for k in range(len(languages))])
    levels = {ORDER: (rows, lang, weight)}
    for n in range(ORDER - 1, 0, -1):
        # continuation counts: how many distinct (n + 1)-grams end in each n-gram
        above, owner, _ = levels[n + 1]
        frame = pd.DataFrame(above[:, -n:].astype(np.int64)).assign(lang=owner)
        frame = frame.groupby([*range(n), "lang"], sort=False).size().reset_index(name="w")
        levels[n] = frame[list(range(n))].to_numpy().astype(np.uint64), frame["lang"].to_numpy(), frame["w"].to_numpy(np.float64)
    uniform = 1.0 / (len(alphabet) + 2)
    lower = None
    for n in range(1, ORDER + 1):
        symbols_, owner, w = levels[n]
        full = np.concatenate([np.zeros((len(symbols_), ORDER - n), np.uint64), symbols_], axis=1)
        key, ctx = _row_hash(full, n), _row_hash(np.concatenate([np.zeros((len(full), 1), np.uint64), full[:, :-1]], axis=1), n - 1)
        keys, at = np.unique(key, return_inverse=True)
        first = np.zeros(len(keys), np.int64)
        first[at] = np.arange(len(key))
        contexts, of = np.unique(ctx, return_inverse=True)
        total = np.zeros((len(contexts), len(languages)))
        kinds = np.zeros_like(total)
        np.add.at(total, (of, owner), w)
        np.add.at(kinds, (of, owner), 1)
        gamma = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.zeros((len(keys), len(languages)))
        own[at, owner] = np.maximum(w - DISCOUNT, 0)
        context_of = of[first]
        if lower is None:
            below = np.full_like(own, uniform)
        else:
            table, p = lower
            below = p[table.find(_row_hash(full[first], n - 1))]
        prob = own / np.maximum(total[context_of], 1) + gamma[context_of] * below
        lower = (Sorted(keys), prob)
        model.tables.append(lower[0])
        model.scores.append(np.log(prob).astype(np.float32))
        model.contexts.append(Sorted(contexts))
        model.backoff.append(np.log(np.maximum(gamma, 1e-12)).astype(np.float32))
    model.limits = np.tile([10.0, 0.0, 0.0], (len(languages), 1))
    return model


def _guess(codes: np.ndarray, weight: np.ndarray) -> float:
    """Nats of a uniform guess over the most frequent symbols that make up nearly all
    letters; the strays of other scripts do not count."""
    letter = codes > UNKNOWN
    often = np.sort(np.bincount(codes[letter].astype(np.int64), weight[letter]))[::-1]
    reached = np.cumsum(often)
    own = int(np.searchsorted(reached, OWN_LETTERS * reached[-1])) + 1 if len(often) else 0
    return float(np.log(own + 2))


def _row_hash(rows: np.ndarray, n: int) -> np.ndarray:
    """``grams`` for explicit rows of ``ORDER`` symbols: the last ``n`` of each."""
    h = np.zeros(len(rows), np.uint64)
    for k in range(ORDER - n, ORDER):
        h = (h + rows[:, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h + np.uint64(n))


def count_grams(sample: DataFrame) -> DataFrame:
    """Counts of ``ORDER``-grams by language over rows (lang, text), summed in Spark."""
    small_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = letters().copy()
        folded[1] = 0
        for batch in batches:
            for lo, hi in cuts(batch.column(1), SLICE_BYTES):
                langs = np.array(batch.column(0).slice(lo, hi - lo).to_pylist(), object)
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                for lang in sorted(set(langs)):
                    codes, _ = symbols([t for t, own in zip(texts, langs) if own == lang], folded)
                    if len(codes) < ORDER:
                        continue
                    window = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
                    window = np.ascontiguousarray(window[window[:, -1] != EDGE].astype("<u4"))
                    kinds, n = np.unique(window.view(f"V{4 * ORDER}").ravel(), return_counts=True)
                    text = kinds.tobytes().decode("utf-32-le")
                    out = [text[i:i + ORDER] for i in range(0, len(text), ORDER)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(out, pa.string()),
                                                      pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_chars: int = SAMPLE_CHARS,
          sample_docs: int = SAMPLE_DOCS, most_languages: int = MOST_LANGUAGES) -> Model:
    """The models of all languages of ``labelled``, from a sample of about
    ``sample_chars`` characters and ``sample_docs`` different texts a language at most; more
    than ``most_languages`` labels are an error, for a model has a column for each."""
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).dropna()
    # copies of a text count once here and in the sample
    texts = rows.select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("n")).distinct()
    sizes = texts.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("chars")).limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} language labels")
    if not sizes:
        return Model([], np.zeros(0, np.uint32))
    share = {r["lang"]: min(1.0, sample_chars / max(1, r["chars"]), sample_docs / r["docs"]) for r in sizes}
    limit = F.element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in share]), F.array(*[F.lit(v) for v in share.values()])), F.col("lang"))
    roll = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(roll < limit).distinct().withColumn("fold", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(CALIBRATION_SHARE)))
    counts = count_grams(sample.filter("fold > 0")).toPandas()
    if counts.empty:
        counts = count_grams(sample).toPandas()
    if counts.empty:
        return Model([], np.zeros(0, np.uint32))
    model = fit(counts)
    return calibrated(model, sample.filter("fold = 0"))


def calibrated(model: Model, kept_out: DataFrame) -> Model:
    """The model with the rejection limits that the kept-out rows of each language show."""
    schema = "lang string, h double, n bigint"
    shared = kept_out.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi in cuts(batch.column(1), SLICE_BYTES):
                langs = batch.column(0).slice(lo, hi - lo).to_pylist()
                h, n, worded = m.entropies(batch.column(1).slice(lo, hi - lo).to_pylist())
                own = [m.languages.index(x) if x in m.languages else -1 for x in langs]
                ok = worded & (np.array(own) >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).filter(pa.array(ok)),
                                                  pa.array(h[np.arange(len(own)), own][ok]), pa.array(n[ok], pa.int64())],
                                                 names=["lang", "h", "n"])

    # moments by language: one row each
    rows = (kept_out.select("lang", "text").mapInArrow(run, schema).withColumn("x", 1 / F.col("n")).groupBy("lang")
            .agg(F.count("*").alias("k"), F.avg("h").alias("mean"), F.variance("h").alias("var"), F.avg("x").alias("x"),
                 F.sum(F.col("h") * F.col("n")).alias("hn"), F.sum("n").alias("n")).collect())
    shared.unpersist()
    limits = np.tile([10.0, 0.0, 0.0], (len(model.languages), 1))
    for r in rows:
        spread = r["var"] or 0.0
        # a character's log-probability varies by about two nats
        limits[model.languages.index(r["lang"])] = (max(r["mean"], r["hn"] / r["n"]), spread, 4.0)
    model.limits = limits
    return model


def identify(df: DataFrame, model: Model, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return map_text(df, text, FIELDS, lambda: lambda column: shared.value.predict(column.to_pylist()), carry, slice_bytes=1 << 20)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
