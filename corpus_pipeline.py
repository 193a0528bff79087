"""A pipeline over `documents`; each stage calls one operator of `skytables.llm`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skytables.llm import jaccard_join, language_id, packing, quality_rules, suffix_dedup
from skytables.llm.common import saved, table, whole_row

#: A document stays if one language has this share of it at least.
MAIN_LANGUAGE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mainly in one language; those without any letter go."""
    model = language_id.train(docs)
    rows = language_id.predict(docs.select(whole_row(docs)), model, ("_doc", "text"))
    kept = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MAIN_LANGUAGE)
    return rows.where(kept).select("_doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long passages that occur more than once."""
    return suffix_dedup.deduplicated(docs, size="n_chars" if "n_chars" in docs.columns else None)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences of byte tokens, with an end token after each document."""
    return packing.best_fit(docs, F.octet_length(F.coalesce("text", F.lit(""))) + 1)


STAGES = [
    ("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("sequences", sequences),
]

#: The stages learn and iterate, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
