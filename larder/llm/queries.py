"""One registered query for each of the thirteen operators, over its whole table, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (collocations, decontaminate, divergence, html_text, language, licenses, near_dups, packing, pii, quality,
                        sharding, url_rules, warc)
from larder.llm.columns import table

#: (host, path, verdict) of the URL rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"), "html", carry=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot; shards of near equal bytes."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 16, carry=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    pages = table(spark, sf_dir, "pages")
    manifest = warc.write_archives(warc.records(pages, "page_id", "url", "html", min_bytes=0))
    key = pages.schema["page_id"].dataType
    return warc.record_table(warc.read_archives(manifest, with_data=False)).select(
        F.col("key").cast(key).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(key).alias("refers_to"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find_pii(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned without the held-out fold."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.train(docs.filter("not held_out"))
    return language.identify(docs, model, carry=["doc_id", "held_out"]).select(
        "doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and statements in every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in their terms."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words belong together most."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_main_text, op2_quality, op3_shards, op4_decontamination, op5_warc, op6_pii, op7_url_filter,
                            op8_language, op9_near_dups, op10_packing, op11_licenses, op12_divergence, op13_collocations)}

_WORDS = r"[^\x20\x09-\x0D]+"
_GRAMS = [3, *quality.NGRAM_LIMITS]
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _gram(n: int) -> str:
    parts = " || ' ' || ".join("w" if k == 0 else f"lead(w, {k}) OVER p" for k in range(n))
    return f"CASE WHEN i + {n - 1} <= total THEN {parts} END AS g{n}"


def _quality_sql() -> str:
    grams = ",\n  ".join(_gram(n) for n in _GRAMS)
    twice = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY rid, g{n}) > 1 AS d{n}" for n in _GRAMS)
    inside = ", ".join(f"bool_or(d{n}) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}"
                       for n in _GRAMS)
    sums = ", ".join(f"coalesce(sum(length(w)) FILTER (c{n}), 0)::BIGINT AS dup_{n}gram_chars" for n in quality.NGRAM_LIMITS)
    rules = " AND ".join(f"100 * coalesce(dup_{n}gram_chars, 0) <= {most} * coalesce(word_chars, 0)"
                         for n, most in quality.NGRAM_LIMITS.items())
    outs = ", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in quality.NGRAM_LIMITS)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT rid, regexp_extract_all(text, '{_WORDS}') AS ws FROM docs),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS total FROM listed),
grams AS (SELECT rid, w, i,
  {grams}
  FROM words WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, w, i, {twice} FROM grams),
inside AS (SELECT rid, w, {inside} FROM twice),
measured AS (SELECT rid, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars,
  count(*) FILTER (c3) AS n_repeat_words, {sums} FROM inside GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
worded AS (SELECT rid, line, count(*) AS k, max(w)::BIGINT AS each FROM (
  SELECT rid, line, list_sum([length(x) FOR x IN regexp_extract_all(line, '{_WORDS}')]) AS w FROM lines
  WHERE regexp_matches(line, '{_WORDS}')) GROUP BY rid, line),
line_sums AS (SELECT rid, sum(k - 1)::BIGINT AS n_dup_lines, coalesce(sum(k * each) FILTER (k > 1), 0)::BIGINT AS dup_line_chars
  FROM worded GROUP BY rid),
joined AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {outs}
  FROM docs LEFT JOIN measured USING (rid) LEFT JOIN line_sums USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM joined)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {quality.LINE_LIMIT} * word_chars AND {rules} AS kept FROM failed"""


def _licenses_sql() -> str:
    templates, phrases = [], []
    for k, (label, wording) in enumerate(licenses.TEMPLATES):
        words = licenses.words_of(wording)
        n, half = len(set(words)), licenses.half_block(len(words))
        templates += [f"({k}, '{label}', '{w}', {n}, {-(-licenses.PERCENT * n // 100)}, {half})" for w in sorted(set(words))]
    for phrase, label in licenses.PHRASES:
        words = licenses.words_of(phrase)
        tests = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(words, 1))
        phrases.append(f"SELECT rid, i, '{label}' AS label FROM places WHERE {tests}")
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
places AS (SELECT rid, ws, unnest(range(0, len(ws))) AS i FROM docs),
base AS ({" UNION ALL ".join(phrases)}),
bases AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM base GROUP BY rid),
templates(t, label, word, n, need, half) AS (VALUES {", ".join(templates)}),
words AS (SELECT rid, i, ws[i + 1] AS word FROM places),
inside AS (SELECT rid, t, label, word, n, need, i // half AS b FROM words JOIN templates USING (word)
  UNION ALL SELECT rid, t, label, word, n, need, i // half - 1 FROM words JOIN templates USING (word) WHERE i >= half),
met AS (SELECT rid, label, count(DISTINCT word) / any_value(n) AS found FROM inside GROUP BY rid, t, label, b
  HAVING count(DISTINCT word) >= any_value(need)),
base_names AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS names FROM (SELECT DISTINCT rid, label FROM base) GROUP BY rid),
all_names AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS names
  FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM met) GROUP BY rid),
best AS (SELECT rid, max(found) AS found FROM met GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(b.names, '') AS base_labels,
  coalesce(a.names, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(found, 0) END::DOUBLE AS score
FROM docs LEFT JOIN bases USING (rid) LEFT JOIN base_names b USING (rid) LEFT JOIN all_names a USING (rid) LEFT JOIN best USING (rid)"""


def _collocations_sql() -> str:
    grams = " UNION ALL ".join(f"SELECT lang, array_to_string(ws[i:i + {n - 1}], ' ') AS phrase, {n} AS size FROM spots "
                               f"WHERE i + {n - 1} <= len(ws)" for n in (1, 2, 3, 4))
    return rf"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM listed GROUP BY lang),
counts AS (SELECT lang, phrase, size, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
cuts AS (SELECT c.lang, c.phrase, c.size, c.a, k, l.a AS l, r.a AS r, 2000000::HUGEINT * c.a // (l.a + r.a) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM counts WHERE size > 1) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
least_cuts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts) WHERE place = 1),
parts AS (SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS phrase, a FROM (
  SELECT lang, a, size, string_split(phrase, ' ') AS ws, m, unnest(range(1, size - m + 2)) AS s
  FROM (SELECT *, unnest(range(2, size)) AS m FROM counts WHERE size > 2))),
absorbing AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY ALL),
placed AS (SELECT c.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, c.a DESC, phrase) AS rank
  FROM least_cuts c LEFT JOIN absorbing USING (lang, phrase) WHERE most IS NULL OR 100 * most < {collocations.ABSORBED} * c.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM placed JOIN totals USING (lang) WHERE rank <= {collocations.TOP}"""


ORACLE: dict[str, str] = {
    "op11_licenses": _licenses_sql(),
    "op12_divergence": rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
terms AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM terms GROUP BY ALL HAVING count(DISTINCT rid) >= {divergence.LEAST_DOCS}),
kinds AS (SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (n + v) AS p,
  1 + 1000000000::HUGEINT * (lang_n + 1) // (lang_total + v) AS lang_p
  FROM groups g JOIN kinds USING (lang) JOIN kept k USING (lang) LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, (p - lang_p) * (p - lang_p) // lang_p AS value
  FROM shares WHERE c > 0 AND p > lang_p),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM placed WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}""",
    "op13_collocations": _collocations_sql(),
    "op2_quality": _quality_sql(),
    "op4_decontamination": rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM items WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
  SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, sizes WHERE len(ws) >= n)),
hits AS (SELECT rid, item_id, n, i FROM spots JOIN wins USING (n, win)),
hit_words AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(found, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)""",
    "op5_warc": """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
bits AS (SELECT *, list_aggregate([substr('0000000100100011010001010110011110001001101010111100110111101111',
  4 * instr('0123456789abcdef', digest[k]) - 3, 4) FOR k IN range(1, 41)], 'string_agg', '') AS b,
  max(page_id) OVER (PARTITION BY digest, payload_bytes) AS newest FROM hashed)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * b[k]::INT + 8 * b[k + 1]::INT + 4 * b[k + 2]::INT
    + 2 * b[k + 3]::INT + b[k + 4]::INT, 1) FOR k IN range(1, 161, 5)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to FROM bits""",
    "op7_url_filter": f"""
WITH parts AS (SELECT row_number() OVER () AS rid, page_id,
  coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
best AS (SELECT rid, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM parts JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (rid)""",
    "op9_near_dups": rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS ws FROM documents),
shingles AS (SELECT DISTINCT rid, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM shingles a JOIN shingles b USING (s) WHERE a.rid <> b.rid GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT rid, rid FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least_ids AS (SELECT reach.a AS rid, min(doc_id) AS component_id FROM reach JOIN docs ON docs.rid = reach.b GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs LEFT JOIN sizes USING (rid) JOIN least_ids USING (rid)""",
}
