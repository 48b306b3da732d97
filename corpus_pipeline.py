"""Corpus pipeline: toxicity, language, near-duplicates, passages, packing.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)``,
works on every row of ``docs`` and returns the columns of documents (the last:
one row per piece of a document with its bin).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import language_id, packing, simhash, substring_dedup, toxicity
from quantloom.llm.shared import discard, materialize, read

#: A document is rejected if its best language is no surer than this part of
#: the way from an even share among the learnt languages to certainty.
LEAST_SURENESS = 0.25


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    classifier = toxicity.fit(spark, docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, classifier)
    return scored.filter(F.col("toxic_score") < toxicity.THRESHOLD).select(*docs.columns)


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not null, not without letters, and not about
    equally likely in all learnt languages.  Without any labelled language, or
    with one only, every text with a letter stays."""
    model = language_id.fit(spark, docs)
    if len(model.languages) < 2:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*docs.columns)
    found = language_id.predict(docs, model)
    even = 1 / len(model.languages)
    least = even + LEAST_SURENESS * (1 - even)
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") > least)
    return found.filter(sure).select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share four fifths of their five-word
    shingles, the one with the smallest doc_id (rows without one stay)."""
    found = simhash.similar_documents(spark, docs)
    drop = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__ql_drop")).distinct()
    kept = docs.join(drop, F.col("doc_id") == F.col("__ql_drop"), "left_anti")
    return kept.select(*docs.columns)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller doc_id holds too; a
    document of which nothing is left goes.  ``n_chars`` follows the text."""
    found = substring_dedup.remove_repeats(spark, docs, changed_only=True)
    left = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bins."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("language", reject_unknown_language),
    ("simhash", keep_one_of_similar),
    ("substring", remove_passages),
    ("packing", pack),
]

#: The stages learn models and pack greedily; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(spark, docs, f"stage-{name}")
            discard(spark, before)
    return docs
