"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, language, near_dups, packing, pii
from larder.llm.columns import table
from larder.llm.shared import folder

#: No SQL expresses the models, the redaction and the packing; tests hold the stages
#: against brute-force versions instead.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined and not rejected. A null or empty text and
    one without letters are rejected; repeated rows are judged one by one; without a
    labelled row to learn from nothing is determined, and an empty table stays empty."""
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"))))
    # the verdicts go into columns of their own, whatever the documents have
    judged = language.identify(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "text"), model)
    return judged.filter("not rejected").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one whose id is the group's least.
    Rows equal in id and text count once; of several texts under a group's least id the
    one of least hash stays; rows without words, or in a group without ids, all stay."""
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"),
                       F.xxhash64("text").alias("t"), "text")
    found = near_dups.near_duplicates(rows, id_column="i", carry=["i", "t"]).filter("kept")
    alone = found.filter("n_shingles = 0 or component_id is null").select("i", "t")
    first = (found.filter("n_shingles > 0 and component_id is not null").groupBy(F.col("component_id").alias("i"))
             .agg(F.min("t").alias("t")))
    stay = alone.union(first).distinct().select(F.col("i").alias("si"), F.col("t").alias("st"))
    once = rows.drop("text").dropDuplicates(["i", "t"])
    return once.join(stay, once["i"].eqNullSafe(stay["si"]) & (once["t"] == stay["st"]), "left_semi").select("row.*")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the rule allows. Null and empty
    texts are clean, repeated rows are judged one by one, and with an empty benchmark, or
    an empty table, every row stays."""
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "text")
    return decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark")).filter("not contaminated").select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind. A null text stays null; an
    empty one, one without personal data and repeated rows stay as they are."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in training sequences. A null or
    empty text is one piece, its end token; repeated rows are pieces of their own, pieces
    of one length go by row and start; an empty table gives no pieces."""
    return packing.pack(packing.pieces(docs, carry=["doc_id"]))


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate_benchmark),
          ("personal_data", redact_personal_data), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result a table of the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = folder(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
