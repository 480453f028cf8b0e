"""License scans, the divergence audit, collocations and their automata; every operator
on tables whose extra columns have the names that the operators use inside."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import (automata, collocations, decontaminate, divergence, html_text, language, licenses, near_dups, packing, pii, quality,
                        sharding, url_rules, warc)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- licenses ------------------------------------------------------------------------

def brute_licenses(text, templates=licenses.TEMPLATES, phrases=licenses.PHRASES, percent=licenses.PERCENT):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    words = find(text)
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in phrases:
        own = find(phrase)
        at = [i for i in range(len(words) - len(own) + 1) if words[i:i + len(own)] == own]
        places += at
        base |= {label} if at else set()
    for label, wording in templates:
        own = find(wording)
        half = 1
        while half < len(own):
            half *= 2
        for lo in range(0, max(len(words), 1), half):
            both = len(set(own) & set(words[lo:lo + 2 * half]))
            if both and 100 * both >= percent * len(set(own)):
                labels.add(label)
                score = max(score, both / len(set(own)))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), 1.0 if places else score)


def license_rows(df):
    return [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in df.collect()]


LICENSED = ["Released under the MIT License.", "released UNDER the mit\n\nlicense and the Apache-License, version 2.0", "mit license " * 3 + "general public license",
            "mitlicense, apache licenses, general  public-license", None, "", "MIT", "license mit", "Licensed under CC BY-NC 4.0.", "licensed under cc by 4.0 only",
            "word " * 300 + licenses.TEMPLATES[1][1] + " word" * 300, "x " * 5000 + "Redistribution and use in source and binary forms, with or without "
            "modification, are permitted provided that the following terms are met", " ".join(reversed(licenses.TEMPLATES[4][1].split())),
            "This work is licensed under the GNU\nGeneral Public\nLicense, version 3.", "über mit license été"]


def test_licenses_match_brute_force(spark, edge_docs, no_docs):
    rows = [(i, t, "x", 1) for i, t in enumerate(LICENSED)] + [(0, LICENSED[0], "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, Labels string, __id int").repartition(3)
    out = licenses.scan_licenses(docs)
    assert out.columns == ["doc_id", "text", "__id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(license_rows(out), key=repr) == sorted((brute_licenses(t) for _, t, *_ in rows), key=repr)
    assert sorted(license_rows(licenses.scan_licenses(edge_docs, carry=[])), key=repr) == sorted(
        (brute_licenses(r.text) for r in edge_docs.collect()), key=repr)
    assert licenses.scan_licenses(no_docs).count() == 0
    assert license_rows(licenses.scan_licenses(docs.filter("doc_id = 8"), templates=[], carry=[])) == [(7, 0, None, None, "", "", 0.0)]


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_the_similarity_join_finds_every_block(spark, percent):
    """Random texts over few words, random templates, at several thresholds."""
    roll = random.Random(percent)
    words = [f"w{k}" for k in range(14)]
    text = lambda n: " ".join(roll.choice(words) for _ in range(n))
    templates = [(f"t{k}", text(roll.choice([1, 2, 3, 5, 8, 9]))) for k in range(12)]
    phrases = [("w0 w1", "p"), ("w2", "q")]
    docs = [(i, text(roll.choice([0, 1, 3, 10, 40, 100]))) for i in range(150)]
    out = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates=templates, phrases=phrases, percent=percent)
    got = {r.doc_id: row for r, row in zip(out.collect(), license_rows(out))}
    assert got == {i: brute_licenses(t, templates, phrases, percent) for i, t in docs}


# --- divergence ----------------------------------------------------------------------

def brute_divergence(rows, least_docs=3, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    in_docs, counts = defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in rows:
        in_docs[lang].update(set(terms(t)))
        counts[lang, source].update(terms(t))
    f = lambda p, q: (p - q) ** 2 // q
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least_docs)
        sources = sorted({r[2] for r in rows if r[1] == lang})

        def shares(total):
            n = sum(total[t] for t in kept)
            return {t: 1 + 10**9 * (total[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            own = [(t, f(p[s][t], whole[t])) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found, 1)]
    return sorted(out)


def divergence_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    return sorted(tuple(r) for r in divergence.divergence(df, **options).collect())


def test_divergence_matches_brute_force(spark, edge_docs, no_docs):
    roll = random.Random(4)
    words = ["der", "Die", "das", "été", "x", "Und", "zwei", "\U0001F600", "don't"]
    rows = [(" ".join(roll.choices(words, weights=range(1, 10), k=roll.randrange(12))), roll.choice(["de", "fr", None]), f"s{roll.randrange(6)}") for _ in range(120)]
    rows += [(None, "de", "void"), ("", None, None), ("once here", "en", "a"), ("12 34", "en", "b"), ("der " * 50, "de", "s0"), ("der " * 50, "de", "s0")]
    rows += [("many " * 40, "one", "src")] * 30
    want = brute_divergence(rows)
    assert divergence_of(spark, rows) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[4] == 0 for r in want)
    assert divergence_of(spark, rows, least_docs=10, top=2) == brute_divergence(rows, 10, 2)
    assert divergence.divergence(no_docs).count() == 0
    edge = [(r.text, r.lang, r.source) for r in edge_docs.collect()]
    assert sorted(tuple(r) for r in divergence.divergence(edge_docs).collect()) == brute_divergence(edge)


def test_terms_of_a_long_text_are_cut_between_words(monkeypatch):
    text = b"alpha, beta " * 400 + b"x" * 300 + b" end"
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "RUN_BYTES", 37)
    assert divergence.term_counts(text) == whole == Counter({b"alpha": 400, b"beta": 400, b"x" * 300: 1, b"end": 1})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from("tuvw"), st.sampled_from("pqrs"), st.integers(1, 10**9)), max_size=40, unique_by=lambda r: r[:3]),
       st.integers(1, 12))
def test_blocks_of_terms_add_up(rows, block):
    """The sums over common terms do not depend on where Arrow batches and blocks end."""
    rows = sorted(rows)
    table = pa.table({"lang": [r[0] for r in rows], "source": [r[2] for r in rows], "term": [r[1] for r in rows],
                      "p": pa.array([r[3] for r in rows], pa.int64()), "p0": pa.array([7 + ord(r[2]) for r in rows], pa.int64())})
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // q
    for lang, term, s, p in rows:
        for lang2, term2, o, q in rows:
            if (lang, term) == (lang2, term2) and s != o:
                p0, q0 = 7 + ord(s), 7 + ord(o)
                want[lang, s, o] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    old, divergence.BLOCK_ROWS = divergence.BLOCK_ROWS, block
    try:
        got = Counter()
        for batch in divergence._common_blocks(iter(table.to_batches(max_chunksize=3))):
            for r in batch.to_pylist():
                got[r["lang"], r["source"], r["item"]] += r["value"]
    finally:
        divergence.BLOCK_ROWS = old
    assert got == want


# --- automata and collocations ---------------------------------------------------------

PATHS = st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=4), st.integers(1, 300)), max_size=60)


def packed(found):
    counts = Counter()
    for path, n in found:
        counts[tuple(path) + (0,) * (4 - len(path))] += n
    rows = sorted(counts)
    return counts, np.array(rows, np.int64).reshape(-1, 4), np.array([counts[r] for r in rows], np.int64)


@settings(max_examples=200, deadline=None)
@given(PATHS, PATHS)
def test_automata_keep_every_count(first, second):
    words = [b"a", b"b", b"c", b"d"]
    built = []
    for found in (first, second):
        counts, paths, n = packed(found)
        made = automata.Automaton.from_sorted(words, *automata.summed(paths, n))
        back = automata.Automaton.loads(made.dumps())
        got = Counter({tuple(p): k for p, k in zip(*(x.tolist() for x in back.sequences()))})
        assert got == counts
        # weights of prefixes are the sums of what goes on from them
        for d, prefix, weight, ended in back.prefixes():
            for p, w, e in zip(prefix[:, :d + 1].tolist(), weight.tolist(), ended.tolist()):
                assert w == sum(k for r, k in counts.items() if list(r[:d + 1]) == p)
                assert e == counts[tuple(p) + (0,) * (3 - d)]
        asked = [[words[k - 1] for k in r if k] for r in counts] + [[b"zz"], [b"a", b"a", b"a", b"zz"], [b"d"]]
        want = [counts.get(tuple(words.index(w) + 1 if w in words else 9 for w in x) + (0,) * (4 - len(x)), 0) for x in asked]
        assert back.compose(automata.labels(back.words, asked)).tolist() == want
        built.append((back, counts))
    together = automata.union([a for a, _ in built])
    assert Counter({tuple(p): k for p, k in zip(*(x.tolist() for x in together.sequences()))}) == built[0][1] + built[1][1]


def test_equal_states_are_one():
    paths = np.array([[a, b, 3, d] for a in range(1, 4) for b in range(1, 4) for d in (1, 2)], np.int64)
    made = automata.Automaton.from_sorted([b"w%d" % k for k in range(1, 6)], *automata.summed(paths, np.ones(len(paths), np.int64)))
    assert [len(label) for label, _, _ in made.arcs] == [3, 3, 1, 2]
    assert sorted(map(tuple, made.sequences()[0].tolist())) == sorted(map(tuple, paths.tolist()))


def test_states_of_equal_hash_are_compared(monkeypatch):
    monkeypatch.setattr(automata, "mix", lambda x: x * np.uint64(0))
    paths = np.array(sorted({(random.Random(k).randint(1, 5), k % 4 + 1, k % 3 + 1, k % 7 % 5 + 1) for k in range(200)}), np.int64)
    n = np.arange(1, len(paths) + 1)
    made = automata.Automaton.from_sorted([b"w%d" % k for k in range(1, 6)], paths, n)
    assert Counter(dict(zip(map(tuple, made.sequences()[0].tolist()), made.sequences()[1].tolist()))) == Counter(dict(zip(map(tuple, paths.tolist()), n.tolist())))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"bb", b"c", b"e"]), min_size=1, max_size=4), max_size=30),
       st.lists(st.lists(st.sampled_from([b"a", b"aa", b"bb", b"d", b"f"]), min_size=1, max_size=4), max_size=6))
def test_borders_cut_where_the_order_says(found, splitters):
    words = [b"a", b"bb", b"c", b"e"]
    rows = sorted({tuple(x) for x in found})
    paths = np.array(sorted([[words.index(w) + 1 for w in x] + [0] * (4 - len(x)) for x in rows]), np.int64).reshape(-1, 4)
    splitters = sorted({tuple(x) for x in splitters})
    assert automata.cut(words, paths, splitters) == [sum(r < s for r in rows) for s in splitters]


def brute_collocations(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def sample_texts(roll, n=250):
    words = ["the", "cat", "Sat", "on", "mat", "été", "b-c", "x\x00y", " z", "rare"]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(roll.randrange(25)):
            t += roll.choices(words, weights=[9, 6, 6, 4, 4, 3, 2, 1, 1, 1])[0] + roll.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"])
        out.append((t, roll.choice(["en", "de", None, ""])))
    return out


@pytest.mark.parametrize("range_bytes", [collocations.RANGE_BYTES, 500])
def test_collocations_match_brute_force(spark, monkeypatch, range_bytes):
    """With one range a language, and with many whose borders cut phrases in two."""
    monkeypatch.setattr(collocations, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(collocations, "BUCKET_ROWS", 20)
    rows = sample_texts(random.Random(11)) + [("same words here again. " * 20, "en")] * 5 + [(None, "en"), ("", "fr"), ("...", "it"), ("lone", "it")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = sorted(tuple(r) for r in collocations.collocations(df, least=8, top=25).collect())
    assert got == brute_collocations(rows, 8, 25)
    assert len({r[0] for r in got}) >= 4


def test_collocations_of_edge_tables(spark, edge_docs, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    rows = [(r.text, r.lang) for r in edge_docs.collect()]
    got = sorted(tuple(r) for r in collocations.collocations(edge_docs, least=5, top=2000).collect())
    assert got == brute_collocations(rows, 5, 2000)


def test_long_texts_are_shards_that_overlap(monkeypatch):
    """A text longer than a shard: no sequence is lost or counted twice at the cuts."""
    monkeypatch.setattr(collocations, "SHARD_WORDS", 50)
    roll = random.Random(9)
    text = " ".join(roll.choice("abc") + ("." if roll.random() < 0.1 else "") for _ in range(700))
    batch = pa.record_batch({"lang": ["en"], "text": pa.array([text.encode()], pa.binary())})
    every = collocations.Sieve(np.full(collocations.SIEVE_BITS // 8, 255, np.uint8))
    found, n = Counter(), 0
    for _, words, paths, counts in every.sequences(iter([batch])):
        n += 1
        for path, k in zip(paths.tolist(), counts.tolist()):
            found[tuple(words[x - 1].decode() for x in path if x)] += k
    want = Counter()
    for piece in text.split("."):
        own = piece.split()
        want.update(tuple(own[i:i + 4]) for i in range(len(own)))
    assert n > 5 and found == want


def test_exact_scores_of_huge_counts():
    counts = {"a b": 2**52, "a": 2**53 + 1, "b": 2**53 + 3}
    candidates = pa.table({"lang": ["x"], "phrase": ["a b"], "a": pa.array([counts["a b"]], pa.int64())})
    answers = pa.table({"of": ["x", "x"], "part": ["a", "b"], "places": pa.array([counts["a"], counts["b"]], pa.int64())})
    assert collocations.scored(candidates, answers).column("score").to_pylist() == [2000000 * counts["a b"] // (counts["a"] + counts["b"])]


# --- names ---------------------------------------------------------------------------

INTERNAL = ["__row", "__doc", "__t", "__x", "__id", "__set", "__len", "__sketch", "__counts", "__few", "__text__", "__base", "__blocks", "__url", "__u",
            "component", "c", "t", "u", "e", "n", "k", "label", "best", "rule_verdict", "prefix", "digest", "full", "items", "hit_ranges", "h", "block",
            "upto", "word", "word_hash", "bucket", "band", "row", "seq", "size", "of", "whole", "rank", "phrase", "term", "kept", "fold", "_chunk", "_pos",
            "payload", "key", "sha1", "newest", "i", "j", "m", "a", "b"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "s", f"http://example.com/en/{i}", "<p>" + t + "</p>") for i, t in enumerate(
        ["the cat sat on the mat " * 4, "the cat sat on the mat " * 4, "released under the mit license", "mail bob@example.com now", "un deux trois quatre cinq six"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string, html string")
    return df, df.select("*", *[F.lit(f"x{c}").alias(c) for c in INTERNAL])


OPERATORS = {
    "main_text": lambda df: html_text.extract(df, "html", carry=None).select("doc_id", "n_chars"),
    "quality": lambda df: quality.quality(df).select("doc_id", "n_words", "word_chars"),
    "shards": lambda df: sharding.shard(df, 3).select("doc_id", "size", "text_crc32"),
    "decontamination": lambda df: decontaminate.decontaminate(df, df.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id = 0")).select("doc_id", "n_words", "n_hit"),
    "decontamination_blocks": lambda df: decontaminate.decontaminate(df, df.select(F.col("doc_id").alias("item_id"), "text"), block_bytes=100).select("doc_id", "n_words", "n_hit", "n_items"),
    "warc": lambda df: warc.record_table(warc.read_archives(warc.write_archives(warc.records(df, "doc_id", "url", "html")))).select("key", "payload_bytes"),
    "pii": lambda df: pii.find_pii(df).select("doc_id", "n_email", "spans"),
    "url_rules": lambda df: url_rules.judge(df, df.sparkSession.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")).select("doc_id", "host", "rule", "verdict"),
    "language": lambda df: language.identify(df, language.train(df)).select("doc_id", "lang_pred"),
    "near_dups": lambda df: near_dups.near_duplicates(df).select("doc_id", "n_shingles", "component_id"),
    "packing": lambda df: packing.pack(packing.pieces(df)).select("doc_id", "length", "doc_tokens"),
    "licenses": lambda df: licenses.scan_licenses(df).select("doc_id", "labels", "score"),
    "divergence": lambda df: divergence.divergence(df),
    "collocations": lambda df: collocations.collocations(df, least=2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_may_have_any_name(clashing, name):
    plain, extra = clashing
    run = OPERATORS[name]
    listed = lambda df: sorted((tuple(r) for r in run(df).collect()), key=repr)
    assert listed(extra) == listed(plain)


def test_near_duplicates_carry_a_column_named_component(clashing):
    plain, extra = clashing
    out = near_dups.near_duplicates(extra)
    assert {r.component for r in out.collect()} == {"xcomponent"} and {r.label for r in out.collect()} == {"xlabel"}


def test_copies_of_a_text_are_one_sample(spark):
    """Fifty thousand copies of one text are one text of the sample; labels are bounded."""
    docs = spark.range(50_000).select(F.lit("eine kleine nacht").alias("text"), F.lit("de").alias("lang")).union(
        spark.createDataFrame([("the cat sat on the mat", "en"), ("a dog and a cat", "en")], "text string, lang string"))
    sizes, real = [], language.count_grams

    def watched(sample):
        sizes.append(sample.count())
        return real(sample)

    old, language.count_grams = language.count_grams, watched
    try:
        model = language.train(docs, sample_docs=4000)
    finally:
        language.count_grams = old
    assert max(sizes) <= 3 and set(model.languages) <= {"de", "en"}
    many = spark.range(30).select(F.lit("text").alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"))
    with pytest.raises(ValueError, match="labels"):
        language.train(many, most_languages=20)
