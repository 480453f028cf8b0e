"""Language models, near duplicates, the pipeline, and the queries against their SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import language, near_dups, pii, queries
from larder.plans.compare import compare, duck_connection

# --- language ------------------------------------------------------------------------


class PlainKneserNey:
    """Interpolated Kneser-Ney by the textbook, over one language's texts."""

    def __init__(self, texts, alphabet_size, order=language.ORDER, discount=language.DISCOUNT):
        self.order, self.discount, self.uniform = order, discount, 1 / (alphabet_size + 2)
        self.counts = {n: Counter() for n in range(1, order + 1)}
        for t in texts:
            s = fold(t)
            for i in range(order - 1, len(s)):
                self.counts[order][s[i - order + 1:i + 1]] += 1
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.total, self.kinds = defaultdict(Counter), defaultdict(Counter)
        for n, grams in self.counts.items():
            for g, c in grams.items():
                self.total[n][g[:-1]] += c
                self.kinds[n][g[:-1]] += 1

    def p(self, gram):
        n = len(gram)
        below = self.p(gram[1:]) if n > 1 else self.uniform
        total = self.total[n][gram[:-1]]
        if not total:
            return below
        return (max(self.counts[n][gram] - self.discount, 0) + self.discount * self.kinds[n][gram[:-1]] * below) / total

    def entropy(self, text):
        s = fold(text)
        logs = [math.log(self.p(s[i - self.order + 1:i + 1])) for i in range(self.order - 1, len(s))]
        return -sum(logs) / len(logs)


def fold(text):
    runs = re.sub(r"[^a-zà-ÿ]+", "\0", text.lower())
    return "\1" * (language.ORDER - 1) + runs.lstrip("\0")


TEXTS = {"xx": ["the cat sat on the mat", "a cat and a dog", "that is the end of it"],
         "yy": ["der hund und die katze", "das ist das ende", "über die brücke"]}


def test_scores_are_interpolated_kneser_ney(spark):
    rows = [(lang, t) for lang, texts in TEXTS.items() for t in texts]
    counts = language.count_grams(spark.createDataFrame(rows, "lang string, text string")).toPandas()
    model = language.fit(counts)
    size = len({c for _, t in rows for c in fold(t)} - {"\0", "\1"})
    probes = ["the dog", "die katze ist", "ends", "über", "the cat sat on the mat", "x y"]
    h, n, worded = model.entropies(probes)
    for lang, texts in TEXTS.items():
        plain = PlainKneserNey(texts, size)
        for k, probe in enumerate(probes):
            if set(fold(probe)) - {"\0", "\1"} <= set("".join(t for _, t in rows)):
                assert abs(h[k, model.languages.index(lang)] - plain.entropy(probe)) < 1e-4, (lang, probe)


def test_held_out_accuracy_and_edges(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", language.held_out(F.col("doc_id")))
    model = language.train(docs.filter("not held"))
    out = language.identify(docs.filter("held"), model)
    n = out.count()
    assert n > 200 and out.filter("lang = lang_pred").count() >= 0.97 * n and out.filter("rejected").count() == 0
    assert out.filter("score < 0 or score > 1").count() == 0
    edges = {r.doc_id: r for r in language.identify(edge_docs, model, carry=["doc_id", "text"]).collect()}
    for i in (0, 1, 2, 11, 15):
        assert edges[i].lang_pred == "und" and edges[i].score == 0 and edges[i].rejected
    assert edges[9].rejected  # an alphabet that was never learned
    assert not edges[6].rejected
    assert language.identify(no_docs, model).count() == 0
    none = language.train(no_docs)
    assert {r.lang_pred for r in language.identify(edge_docs, none).collect()} == {"und"}


def test_a_large_alphabet_does_not_end_rejection(spark):
    roll = np.random.default_rng(7)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang in ('en', 'fr')").select("lang", "text").collect()
    # 3,000 Chinese letters by Zipf's law, and English texts with a stray of them each
    share = 1 / np.arange(1, 3001)
    han = lambda n: "".join(chr(0x4E00 + k) for k in roll.choice(3000, n, p=share / share.sum()))
    rows = [(r.lang, f"{r.text} {han(3)}" if r.lang == "en" else r.text) for r in docs] + [("zh", han(400)) for _ in range(400)]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.alphabet) > 2500
    noise = ["".join(x) for x in roll.choice(list("abcdefghijklmnopqrstuvwxyz "), (20, 200))]
    foreign = ["Il gatto dorme sulla sedia mentre la nonna prepara la cena per tutta la famiglia riunita attorno al grande tavolo.",
               "De kat slaapt op de stoel terwijl oma het avondeten klaarmaakt voor de hele familie die rond de grote tafel zit."]
    known = [r.text for r in docs][:200] + [han(200) for _ in range(20)]
    assert all(model.predict(noise + foreign)[3].to_pylist())
    assert not any(model.predict(known)[3].to_pylist())


# --- near duplicates -----------------------------------------------------------------

def brute_sets(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    sets = [brute_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [k for k in least[find(i)] if k is not None]
        c = (min(ids) if ids else None) if sets[i] else key
        out.append((key, len(sets[i]), c, key == c))
    return out


def check_components(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in near_dups.near_duplicates(df, carry=["doc_id"]).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_families_of_near_copies(spark):
    """Copies that are near a base but not each other, chains, exact copies, and texts
    that share a long passage without being near."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 6])):
            copy[rnd.randrange(len(copy))] = word()
        rows.append((1000 + i, " ".join(copy)))
    chain = [word() for _ in range(100)]
    for i in range(12):
        rows.append((500 + i, " ".join(chain[3 * i:3 * i + 60])))
    passage = " ".join(word() for _ in range(40))
    rows += [(200 + i, passage + " " + " ".join(word() for _ in range(rnd.choice([5, 12, 30])))) for i in range(20)]
    rows += [(i, "same short text") for i in range(50)] + [(60, "Same SHORT text"), (61, "same short"), (62, None), (63, ""), (64, " \n")]
    rows += [(None, "same short text"), (None, "a text of its own that no one shares"), (None, None), (1000, " ".join(base))]
    check_components(spark, rows)


def test_small_sets(spark):
    """Sets of a few shingles, where most sketch slots are borrowed."""
    words = "a b c d e f g h i j k l m n o".split()
    rows = [(n * 10 + k, " ".join(words[k:k + n])) for n in range(1, 14) for k in range(0, 3) if k + n <= len(words)]
    check_components(spark, rows)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            copy[rnd.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    check_components(spark, rows)


def test_densified_sketches_estimate_the_similarity():
    rnd = np.random.default_rng(1)
    for n in (8, 40, 400):
        agreed = []
        for _ in range(60):
            union = rnd.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            a, b = np.sort(union[:-n // 8]), np.sort(union[n // 8:])
            s = near_dups.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
            agreed.append((s[0] == s[1]).mean())
        assert abs(np.mean(agreed) - 0.75) < 0.05, n


def test_near_duplicates_edges(spark, edge_docs, no_docs):
    out = near_dups.near_duplicates(edge_docs)
    assert out.count() == edge_docs.count() and [c.lower() for c in out.columns].count("kept") == 1
    assert near_dups.near_duplicates(no_docs).count() == 0
    assert near_dups.fingerprint(pa.array([None, "", "x"]), 75)[0].to_pylist() == [0, 0, 1]


# --- pipeline and queries --------------------------------------------------------------

def test_sets_of_a_few_shingles_never_miss_a_link(spark):
    """Seven and eight words, three of four shingles shared: sketches of so few hashes may
    share no band, the rarest shingles always meet. Some shingles are in a third of the texts."""
    roll = random.Random(3)
    whole = [" ".join(f"w{roll.randrange(10**6)}" for _ in range(8)) for _ in range(3000)]
    whole += ["all these texts end the same " + " ".join(f"v{roll.randrange(10**6)}" for _ in range(24)) for _ in range(300)]
    rows = [(2 * k + side, x.rsplit(" ", 1)[0] if side else x) for k, x in enumerate(whole) for side in (0, 1)]
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize("n", [60, 63, 64, 65, 80, 85, 86])
def test_sets_on_both_sides_of_few_are_linked(spark, n):
    roll = random.Random(n)
    words = [f"w{roll.randrange(10**6)}" for _ in range(n + 4)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-(n // 5)])), (3, " ".join(words[n // 2:] + words[:n // 2]))]
    check_components(spark, rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=300), st.lists(st.integers(0, 400), max_size=300))
def test_counts_bound_the_shared_hashes(x, y):
    """The bound is never below the intersection, whatever the sizes, and 255 is open-ended."""
    spread = lambda v: np.unique(near_dups.mix(np.array(v, np.uint64) + np.uint64(1)) if len(v) else np.zeros(0, np.uint64))
    a, b = spread(x), spread(y)
    most = near_dups.most_shared(near_dups.stretch_counts(a), near_dups.stretch_counts(b))
    assert most >= len(np.intersect1d(a, b))
    packed = np.arange(1000, dtype=np.uint64)    # all in one stretch
    assert near_dups.most_shared(near_dups.stretch_counts(packed), near_dups.stretch_counts(packed)) >= 1000


def test_texts_near_the_threshold_against_all_pairs(spark):
    """Pairs just above and below 75 %, sets of 66 shingles and more."""
    roll = random.Random(8)
    rows = []
    for k in range(150):
        words = [f"w{roll.randrange(10**6)}" for _ in range(roll.choice([70, 90, 200]))]
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join(words[:int(len(words) * roll.uniform(0.72, 0.8))])))
    check_components(spark, rows)


def test_long_texts_are_cut_into_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_BYTES", 2000)
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(30):
        copy = list(base)
        for _ in range(rnd.choice([1, 3, 5, 7])):
            copy[rnd.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    check_components(spark, rows)


def test_pipeline_stages(spark, smoke_dir):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12345 --", "en", "s", 8), (10**6 + 1, None, "en", "s", 0), (10**6 + 2, "mail bob@example.com today please my friend", "en", "s", 45),
                                   (10**6 + 2, "mail bob@example.com today please my friend", "en", "s", 45)], docs.schema)
    now = docs.union(extra)
    before = {r.doc_id: r.text for r in now.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, smoke_dir).cache()
        if k < 4:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        ids = {r.doc_id for r in out.collect()}
        if name == "language":
            assert set(before) - ids == {10**6, 10**6 + 1}
        elif name == "near_duplicates":
            want = {c for _, n, c, kept in brute_components([(r.doc_id, r.text) for r in now.collect()]) if kept}
            assert ids == want and out.count() == len(want)
        elif name == "decontamination":
            verdict = {r.doc_id: r.contaminated for r in queries.op4_decontamination(spark, smoke_dir).collect()}
            assert ids == {r.doc_id for r in now.collect() if not verdict.get(r.doc_id)}
        elif name == "personal_data":
            for r in out.collect():
                assert r.n_chars == len(r.text) and r.text == pii.redacted(before[r.doc_id], pii.describe(before[r.doc_id])[5])
            assert "bob@" not in "".join(r.text for r in out.collect())
        else:
            assert ids == {r.doc_id for r in now.collect()}
        now = out


def test_dedup_stage_keeps_rows_without_id_or_words(spark, smoke_dir):
    rows = [(None, "alone in the world of texts", "en", "s", 1), (None, None, "en", "s", 1), (3, "", "en", "s", 0), (4, "", "en", "s", 0),
            (5, "same words here and there", "en", "s", 1), (5, "same words here and there", "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, smoke_dir).collect()
    assert sorted(str(r.doc_id) for r in out) == ["3", "4", "5", "None", "None"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, smoke_dir, name):
    res = compare(queries.QUERIES[name](spark, smoke_dir), duck_connection(smoke_dir), queries.ORACLE[name])
    assert res["schema_match"] and res["values_match"], res


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_covers_its_table(spark, smoke_dir, name):
    out = queries.QUERIES[name](spark, smoke_dir)
    key = "page_id" if "page_id" in out.columns else "doc_id"
    table = spark.read.parquet(f"{smoke_dir}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert out.select(key).distinct().count() == table.count()
    assert name == "op10_packing" or out.count() == table.count()
