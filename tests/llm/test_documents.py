"""Quality, sharding, decontamination, personal data and packing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import decontaminate, packing, pii, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)

    def chars(n):
        seen = Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
        inside = {j for i in range(len(words) - n + 1) if seen[tuple(words[i:i + n])] > 1 for j in range(i, i + n)}
        return len(inside), sum(len(words[j]) for j in inside)

    lines = [x for x in text.split("\n") if WORD.search(x)]
    often = Counter(lines)
    total = sum(map(len, words))
    dup_line = sum(len(w) for x in lines if often[x] > 1 for w in WORD.findall(x))
    grams = {n: chars(n)[1] for n in quality.NGRAM_LIMITS}
    repeat = chars(3)[0]
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    kept = not failed and 100 * dup_line <= quality.LINE_LIMIT * total and all(
        100 * grams[n] <= most * total for n, most in quality.NGRAM_LIMITS.items())
    return (len(words), total, sum(c in "#*$%&|<>" for c in text), len(lines) - len(often), repeat, dup_line,
            *grams.values(), failed, kept)


def test_quality_matches_brute_force(edge_docs, spark, smoke_dir):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet").select("doc_id", "text")
    for df in (edge_docs.select("doc_id", "text"), docs):
        got = quality.quality(df).collect()
        names = [f.name for f in quality.fields(quality.NGRAM_LIMITS)]
        for r in got:
            assert tuple(r[c] for c in names) == brute_quality(r["text"]), r["text"]


def test_quality_edges(edge_docs, no_docs):
    out = quality.quality(edge_docs)
    assert out.columns.count("n_words") == 1 and "N_WORDS" not in out.columns and "Kept" not in out.columns
    assert out.count() == edge_docs.count()
    assert quality.quality(no_docs).count() == 0


def brute_contaminated(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = find(text), set(), set()
    for item, t in items:
        own = find(t)
        n = min(13, len(own))
        wins = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


BENCH = [(1, "Two WORDS"), (2, "a b c d"), (3, None), (4, "--"), (10, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"), (None, "one"),
         (1, "Two WORDS"), (5, "the cat sat on the mat the cat sat on the mat the cat sat"), (6, "été")]


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 150])
def test_decontamination_matches_brute_force(spark, edge_docs, block_bytes):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    carry = ["doc_id", "text"]
    got = decontaminate.decontaminate(edge_docs.select(*carry), bench, carry=carry, block_bytes=block_bytes).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        want = brute_contaminated(r["text"], BENCH)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, r["text"]
        flat = r.hit_ranges
        assert sum(b - a for a, b in zip(flat[::2], flat[1::2])) == r.n_hit


def test_blocks_of_the_benchmark_are_bounded(spark, monkeypatch):
    """A third of the rows equal and one huge item: ten blocks or more, none above the
    bound and one piece, one Python worker a task, the same answer."""
    roll = random.Random(2)
    word = lambda: "".join(roll.choice("abcdef") for _ in range(4))
    huge = [word() for _ in range(900)]
    items = [(7, " ".join(huge)), *[(8, "the same item, " * 6)] * 40, *[(100 + i, " ".join(word() for _ in range(20))) for i in range(30)]]
    docs = [(i, " ".join(huge[30 * i:30 * i + 25] + [word() for _ in range(30)])) for i in range(25)] + [(99, "the same item, " * 6), (98, None)]
    sizes, build = [], decontaminate.Tables.__init__

    def watched(self, own, window=13):
        build(self, own, window)
        sizes.append((sum(len(t) for _, t in own), self.nbytes()))

    monkeypatch.setattr(decontaminate.Tables, "__init__", watched)
    plans = []
    stored = decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df, name))[1])
    out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
                                      carry=["doc_id"], block_bytes=600)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(sizes) >= 10 and max(n for n, _ in sizes) <= 600 + 150
    assert all(p.count("MapInArrow") <= 1 for p in plans)
    assert all(b <= 8 * n for n, b in sizes)    # 26 bytes a word of four letters and a space
    for r in out.collect():
        want = brute_contaminated(dict(docs)[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, r.doc_id


def test_decontamination_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(edge_docs, none).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(no_docs, spark.createDataFrame(BENCH, none.schema)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=18), max_size=5))
def test_word_search_matches_brute_force(text, items):
    import pyarrow as pa
    bench = [(i, " ".join(x)) for i, x in enumerate(items)]
    n, ranges, found = decontaminate.occurrences(decontaminate.Tables(bench), pa.array([" ".join(text)]))
    want = brute_contaminated(" ".join(text), bench)
    assert (int(n[0]), sum(b - a for a, b in decontaminate.merged(ranges[0])), len(found[0])) == want[:3]


# --- sharding ------------------------------------------------------------------------

@pytest.mark.parametrize("tolerance", [0.01, 0.0])
def test_shards_are_whole_and_near_equal(spark, smoke_dir, tolerance):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    rows = sharding.shard(docs, 16, carry=["doc_id", "text"], tolerance=tolerance).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r[0] for r in docs.select("doc_id").collect())
    by = {}
    for r in rows:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        by.setdefault(r.shard, []).append(r)
    sizes = [sum(r["size"] for r in by[s]) for s in range(16)]
    largest = max(r["size"] for r in rows)
    assert max(sizes) - min(sizes) <= largest + 0.02 * sum(sizes) / 16
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))


def test_shard_edges(edge_docs, no_docs, spark):
    rows = sharding.shard(edge_docs, 4).collect()
    assert len(rows) == edge_docs.count()
    assert sharding.shard(no_docs, 4).count() == 0
    # a third and more of all rows the same: still split evenly, copies next to each other
    hot = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    got = sharding.shard(hot, 16).groupBy("shard").agg(F.sum("size").alias("s"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert len(got) == 16 and all(r.m == r.n - 1 for r in got)
    assert max(r.s for r in got) - min(r.s for r in got) <= 0.02 * sum(r.s for r in got) / 16 + 20
    # rows repeated in every column
    same = spark.createDataFrame([(1, "x")] * 500, "doc_id long, text string")
    got = sharding.shard(same, 16).groupBy("shard").count().collect()
    assert len(got) == 16 and max(r[1] for r in got) - min(r[1] for r in got) <= 1


# --- personal data -------------------------------------------------------------------

BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def brute_luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def brute_base(text):
    def ok(kind, s):
        digits = re.sub(r"[^0-9]", "", s)
        return (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in s.split("."))
                or kind == "card" and 16 <= len(digits) <= 19 and brute_luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15)
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in p.finditer(text) if ok(k, m.group())]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@-+ 2(5)", max_size=60))
def test_base_spans_match_the_plain_patterns(text):
    assert sorted(pii.detect(text)) == sorted(brute_base(text))


def test_base_spans_on_documents(spark, smoke_dir):
    docs = [r.text for r in spark.read.parquet(f"{smoke_dir}/documents.parquet").collect() if r.text]
    docs += ["4111 1111 1111 1111 and 4111111111111112", "+49 (30) 1234567 or +1234", "1.2.3.4.5.6.7.8 999.1.1.1"]
    for text in docs:
        assert sorted(pii.detect(text)) == sorted(brute_base(text))


@pytest.mark.parametrize("text, want", [
    ("mail bob.smith [at] example [dot] com now", ["email:5:37"]), ("bob at example dot com", ["email:0:22"]),
    ("bоb@exаmple.com", ["email:0:15"]), ("bo​b@ex.com", ["email:0:11", "email:3:11"]),
    ("ｂｏｂ＠ｅｘ．ｃｏｍ", ["email:0:10"]),
    ("call plus four four two zero seven nine four six zero nine five eight ok", ["phone:5:69"]),
    ("four one one one one one one one one one one one one one one one", ["card:0:64"]),
    ("1 9 2 dot one six eight dot 0 dot 1", ["ip:0:35"]), ("bob&#64;example&#46;com", ["email:0:23"]),
    ("bob%40example.com", ["email:0:17"]), ("call plus four nine double seven one triple two eight six five", ["phone:5:62"]),
    ("we met at noon. Then (at) home, at last. The dot", []), ("one two three four five", []), ("a @ b", [])])
def test_disguises(text, want):
    assert pii.describe(text)[5].split(",") == (want or [""])


@pytest.mark.parametrize("text, want", [
    ("jane at example dot\ncom", "email:0:23"), ("jane at example\tdot com", "email:0:23"), ("a dot b at example.com", "email:0:22"),
    ("4111 dash 1111 dash 1111 dash 1111", "card:0:34"), ("+49 dash 30 dash 1234567", "phone:0:24"),
    ("10&period;1&period;2&period;3", "ip:0:29"), ("call plus\nfour 4 2 0 7 9 4 6", "phone:5:28"),
    ("plus fıve ſix 2 0 7 9 4 6", "phone:0:25")])
def test_disguises_that_need_no_other_hint(text, want):
    assert want in pii.describe(text)[5].split(",")


DISGUISES = ["4111", "4", "0", "30", "one", "Two", "oh", "dash", "minus", "dot", "point", "plus", "double", "Triple", "at", "jane", "com",
             "example", "+", "-", ".", ",", " ", "  ", "\n", "\t", "_", "é", "@", "[", "]", "(", ")", "&period;", "&#64;", "%40", "\u00a0", "а", "ſix", "nİne"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(DISGUISES) | st.sampled_from([" ", " dash ", " at ", " dot ", "\ndot "]), max_size=14))
def test_hints_change_no_span(parts):
    text = "".join(parts)
    hints, base = pii.hints, pii.detect(text)
    found = pii.added(text, base)
    pii.hints = lambda _: (True, True, True)
    try:
        assert pii.added(text, base) == found
    finally:
        pii.hints = hints


def test_pii_edges(edge_docs, no_docs):
    out = pii.find_pii(edge_docs)
    assert out.count() == edge_docs.count() and pii.find_pii(no_docs).count() == 0
    null = out.filter("doc_id = 0").first()
    assert null.spans == "" and null.base_sha256 == hashlib.sha256(b"").hexdigest()
    again = pii.redact(edge_docs)
    assert again.columns == edge_docs.columns and again.filter("doc_id = 0").first().text is None
    for hard in ("a" * 100_000, "1" * 100_000, " " * 100_000, "1." * 50_000, "a dot " * 20_000, "a." * 50_000 + "@", "one " * 30_000):
        pii.describe(hard)


# --- packing -------------------------------------------------------------------------

def test_ids_are_those_of_the_tokenizers_library(spark, smoke_dir):
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    exact.encode_special_tokens = True
    encode = packing.encoder(packing.VOCABULARY)
    texts = [r.text for r in spark.read.parquet(f"{smoke_dir}/documents.parquet").collect() if r.text]
    texts += ["<|endoftext|> 你好 \U0001f600  x y　z", "x" * 5000, " " * 3000, "it's we'll I'D \r\n\r\n\t 12345", "กำ́"]
    for text in texts:
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids


def test_piece_ids_are_those_of_the_unmodified_tokenizer(spark):
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    texts = ["end <|endoftext|> of text", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|EndOfText|> <|endoftext", "no such string",
             "<|endoftext|>" + "x" * 600, " " * 600 + "<|endoftext|> 你好"]
    assert 50256 in exact.encode(texts[0], add_special_tokens=False).ids
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pieces(docs, carry=["doc_id"], with_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = [*exact.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert list(r.ids) == ids and r.doc_tokens == r.length == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_first_fit_matches_a_plain_scan(lengths):
    free, want = [], []
    for n in lengths:
        k = next((i for i, f in enumerate(free) if f >= n), len(free))
        if k == len(free):
            free.append(50)
        free[k] -= n
        want.append(k)
    assert packing.first_fit(lengths, 50) == want


def test_packing_round_trip(spark, smoke_dir, edge_docs, no_docs):
    encode = packing.encoder(packing.VOCABULARY)
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet").select("doc_id", "text").union(edge_docs.select(F.col("doc_id") + 10**6, "text"))
    rows = packing.pack(packing.pieces(docs, carry=["doc_id", "text"], with_ids=True), group_pieces=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert 1 <= r.length <= 2048 and len(r.ids) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault((r.doc_id, r.text), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    copies = Counter((r.doc_id, r.text) for r in docs.collect())
    assert set(by_doc) == set(copies)
    for (key, text), parts in by_doc.items():
        ids = [*encode(text or ""), 1]
        assert sum(r.length for r in parts) == copies[key, text] * len(ids)
        assert all(r.doc_tokens == len(ids) and list(r.ids) == ids[r.start:r.start + r.length] for r in parts)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(packing.pieces(no_docs)).count() == 0
