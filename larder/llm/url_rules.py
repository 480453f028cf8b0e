"""URL filters: each distinct URL is expanded into host-suffix and path-prefix
expressions, the expressions meet the rules in an equi-join on a short hash prefix, full
digests confirm, and the longest confirmed rule wins.

The verdict depends on the URL alone, so a hot URL or host is one row per distinct URL
in the join. Hosts are cut only to the numbers of labels that occur in the rules, paths
only at the lengths that occur there, which keeps every suffix and any path prefix (not
just whole segments) exact at a number of expressions that the rules bound, whatever the
length of a host.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and gets the default verdict; an empty rule table leaves every URL to the default;
repeated rules count once; of rules of equal length for one URL (they then share the
host and path) ``block`` wins; rules with a null part are left out; extra columns of
``df`` that clash with a result column give way to it, any other name may occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULTS = ("host", "path", "rule", "verdict")
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def n_labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every host suffix of a rule's number of labels, with every path prefix of a rule's length."""
    some = lambda *found: F.filter(F.array(*found), lambda x: x.isNotNull())
    suffixes = some(*[F.when(n_labels(host) >= k, F.substring_index(host, ".", -k)) for k in labels])
    prefixes = some(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths])
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, the winning ``rule`` and the ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``)."""
    rules = (rules.select("host", "path", "verdict").dropna()
             .groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict")))
    # one row per distinct number of labels and path length, at most as many as the rules hold
    shapes = rules.select(n_labels(F.col("host")).alias("labels"), F.length("path").alias("length")).distinct().collect()
    labels, lengths = sorted({r["labels"] for r in shapes}) or [1], sorted({r["length"] for r in shapes}) or [0]
    keep = [c for c in df.columns if c.lower() not in RESULTS]
    digest = F.sha2(F.concat(F.col("host"), F.lit("\n"), F.col("path")), 256)
    by_prefix = rules.select(F.substring(digest, 1, PREFIX_HEX).alias("prefix"), digest.alias("digest"),
                             F.concat("host", "path").alias("rule"), "rule_verdict",
                             F.length(F.concat("host", "path")).alias("size"))
    urls = df.select(F.col(f"`{url}`").alias("u")).filter(F.col("u").contains("://")).distinct()
    wanted = urls.select("u", F.explode(expressions(host_of(F.col("u")), path_of(F.col("u")), labels, lengths)).alias("e"))
    wanted = wanted.select("u", F.sha2("e", 256).alias("full")).withColumn("prefix", F.substring("full", 1, PREFIX_HEX))
    best = (wanted.join(by_prefix, "prefix").filter(F.col("full") == F.col("digest"))
            .groupBy("u").agg(F.max(F.struct("size", "rule_verdict", "rule")).alias("best")))
    best = best.select(F.col("u").alias("__u"), F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))
    # the rows' own columns travel in one, whatever their names
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    joined = df.select(row.alias("__row"), F.col(f"`{url}`").alias("__url")).join(best, F.col("__url") == F.col("__u"), "left")
    return joined.select(*[F.col("__row")[c].alias(c) for c in keep], host_of(F.col("__url")).alias("host"),
                         path_of(F.col("__url")).alias("path"), "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
