"""Source divergence audit: how the terms of each source differ from those of the other
sources and of the whole language.

A text is tokenised by one ``bytes.translate`` that lowers A-Z and blanks every ASCII
byte that is no letter, and ``bytes.split``; a ``Counter`` for each document gives its
terms. Tasks add up counts and documents by (lang, source, term) and hand on sums, so a
hot source or a frequent term is one row for each of a task's flushes. One shuffle by
(lang, term) puts the sources of a term together; terms in at least ``least_docs``
documents of the language are kept. Only counts above 0 are stored (sparse): a source's
other terms all have the same share, which is arithmetic.

With ``p = 1 + floor(1e9 * (count + 1) / (N + V))`` and ``f(p, q) = floor((p - q)^2 / q)``,
and p0 the share of a term that a source lacks, the sum over all V terms for a pair is

  V f(p0, q0)
  + sum over the first's terms of  f(p, q0) - f(p0, q0)
  + sum over the second's terms of f(p0, q) - f(p0, q0)
  + sum over common terms of       f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The second and third sums need one row for each distinct share of a source, the last one
is added up over blocks of terms in numpy, in 64-bit integers. Shares stay below 1e9 + 2, so
squares fit 63 bits; N + V must be below 9e15.

Defined cases: null text, lang and source count as ''; a null or empty text gives its
group no terms but the group is listed; repeated rows count one by one; a language
without kept terms has pairs of value 0; an empty table gives no rows; a very long text
is tokenised in runs cut between words (the memory a task needs follows the different
terms of one text); ties in value go by the item's UTF-8 bytes; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.columns import small_batches
from larder.llm.ranked import first_per_group
from larder.llm.shared import stored

LEAST_DOCS = 3
TOP_TERMS = 200
#: Letters lowered, bytes of other scripts as they are, everything else blank.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a text tokenised at a time, and sums a task holds before it hands them on.
RUN_BYTES = 1 << 22
HELD = 200_000
#: Rows of a block of terms.
BLOCK_ROWS = 50_000


def runs(data: bytes) -> Iterator[list[bytes]]:
    """The words of a translated text, some megabytes at a time."""
    lo = 0
    while len(data) - lo > RUN_BYTES:
        hi = data.rfind(b" ", lo, lo + RUN_BYTES)
        hi = data.find(b" ", lo + RUN_BYTES) if hi < 0 else hi
        if hi < 0:
            break
        yield data[lo:hi].split()
        lo = hi + 1
    yield data[lo:].split()


def term_counts(data: bytes) -> Counter:
    """How often one text holds each term."""
    found: Counter = Counter()
    for words in runs(data.translate(TABLE)):
        found.update(words)
    return found


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(lang, source, term, n, docs[term]) for (lang, source), (counts, docs) in held.items() for term, n in counts.items()]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        columns = zip(*rows) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        texts = batch.column(2)
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            found = term_counts(texts[i].as_py())
            counts, docs = held.setdefault(key, (Counter(), Counter()))
            size -= len(counts)
            for term, n in found.items():
                counts[term] += n
            docs.update(found.keys())
            size += len(counts)
            if size > HELD:
                yield flush()
                held, size = {}, 0
    yield flush()


def share(count: str, total: str) -> Column:
    """1 + floor(1e9 * (count + 1) / total) in 64 bits: nine decimals of the quotient, three at a time."""
    out, rest = f"(({count} + 1) div {total})", f"(({count} + 1) % {total})"
    for _ in range(3):
        out, rest = f"({out} * 1000 + ({rest} * 1000) div {total})", f"(({rest} * 1000) % {total})"
    return F.expr(f"1 + {out}")


def distance(p: str, q: str) -> str:
    """f(p, q), as SQL."""
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def common(table: pa.Table) -> pa.RecordBatch:
    """The last sum for the sources that share terms, over rows of whole terms in order."""
    table = table.combine_chunks()
    codes = {c: table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source")}
    lang, term, source = (codes[c].indices.to_numpy().astype(np.int64) for c in ("lang", "term", "source"))
    langs, names = codes["lang"].dictionary, codes["source"].dictionary
    p, p0 = (table.column(c).to_numpy() for c in ("p", "p0"))
    n, gap = len(names), 1
    pairs, sums = [], []
    f = lambda x, y: (x - y) * (x - y) // y
    while gap < len(term):
        # the rows of a term stand together: each with the one ``gap`` places on
        i = np.flatnonzero((term[gap:] == term[:-gap]) & (lang[gap:] == lang[:-gap]))
        if not len(i):
            break
        for a, b in ((i, i + gap), (i + gap, i)):
            value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
            pair = (lang[a] * n + source[a]) * n + source[b]
            by = np.argsort(pair, kind="stable")
            first = np.flatnonzero(np.r_[True, pair[by][1:] != pair[by][:-1]])
            pairs.append(pair[by][first])
            sums.append(np.add.reduceat(value[by], first))
        gap += 1
    pair = np.concatenate([np.zeros(0, np.int64), *pairs])
    value = np.concatenate([np.zeros(0, np.int64), *sums])
    columns = [langs.take(pa.array(pair // (n * n))), names.take(pa.array(pair // n % n)), names.take(pa.array(pair % n))] if len(pair) else \
        [pa.array([], pa.string())] * 3
    return pa.RecordBatch.from_arrays([*columns, pa.array(value)], names=["lang", "source", "item", "value"])


def _common_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``common`` over blocks of some ten thousand rows of a sorted partition, cut between terms."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= BLOCK_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            last = table.slice(size - 1)
            same = pc.and_(pc.equal(table.column("term"), last.column("term")[0]), pc.equal(table.column("lang"), last.column("lang")[0]))
            cut = size - pc.sum(same).as_py()
            if cut:
                yield common(table.slice(0, cut))
            held, size = table.slice(cut).to_batches(), size - cut
    if size:
        yield common(pa.Table.from_batches(held))


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
               least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distance to every other
    source of the language (``pair``), and the ``top`` terms it uses more than the language
    does (``term``)."""
    small_batches(df.sparkSession)
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = df.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).cast("binary").alias("text"))
    sums = docs.mapInArrow(_sums, "lang string, source string, term binary, n bigint, docs bigint")
    by_term = Window.partitionBy("lang", "term")
    counts = (sums.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
              .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
              .withColumns({"in_docs": F.sum("docs").over(by_term), "lang_n": F.sum("n").over(by_term), "one": F.min("source").over(by_term)})
              .filter(F.col("in_docs") >= least_docs)
              .select("lang", "source", "term", "n", "lang_n", (F.col("one") == F.col("source")).cast("bigint").alias("first")))
    counts = stored(counts, "term-counts")

    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    by_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("kinds"))
    groups = (docs.select("lang", "source").distinct().join(totals.drop("firsts"), ["lang", "source"], "left").join(by_lang, "lang", "left")
              .na.fill(0, ["total", "lang_total", "kinds"]))
    # a language without kept terms has no shares; 1 keeps the division defined
    groups = groups.withColumn("whole", F.greatest(F.expr("total + kinds"), F.lit(1))).withColumn("p0", share("0L", "whole"))
    groups = stored(groups, "term-groups")

    terms = counts.join(groups, ["lang", "source"])
    terms = terms.withColumn("p", share("n", "whole")).withColumn("q", share("lang_n", "(lang_total + kinds)"))
    over = terms.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value"))
    ranked = first_per_group(over, ["lang", "source"], [F.desc("value"), F.asc("item")], "item", top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "kinds")
    base = groups.drop("kinds").join(other, "lang").filter("source <> item").select(
        "lang", "source", "item", F.expr(f"kinds * {distance('p0', 'q0')}").alias("value"))
    shares = terms.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    met = shares.join(other.drop("kinds"), "lang").filter("source <> item")
    first = met.select("lang", "source", "item", F.expr(f"n * ({distance('p', 'q0')} - {distance('p0', 'q0')})").alias("value"))
    second = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                        F.expr(f"n * ({distance('q0', 'p')} - {distance('q0', 'p0')})").alias("value"))
    both = (terms.select("lang", "source", "term", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
            .mapInArrow(_common_blocks, "lang string, source string, item string, value bigint"))
    pairs = base.union(first).union(second).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    placed = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))
    columns = lambda x, part: x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(placed, "pair").union(columns(ranked, "term"))
