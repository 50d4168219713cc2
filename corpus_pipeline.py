"""From raw documents to packed sequences: toxicity, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each one's rows and reads them again as the
next one's docs. All stages but the last keep the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import arrow, language_id, ngram_join, packing, toxicity

#: SQL can't express the models of the first two stages.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go. The models learn from the labelled documents of this input."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.5)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, and those that resemble no language (a certainty under 0.35, see `known_language`), go."""
    return language_id.known_language(docs, language_id.train(docs), least=0.35)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.8 over five-word shingles connect, the one with the smallest id stays.

    An id stands for one document: rows that repeat it stay or go together. Rows without an id, and texts without words, stay.
    """
    classes = ngram_join.similar_classes(docs, width=5, percent=80)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and offset."""
    return packing.pack_documents(docs, capacity=2048, end_id=0)


STAGES = [("toxicity", drop_toxic), ("language_id", keep_known_languages), ("ngram_jaccard_join", keep_one_of_each_group), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stash = arrow.Stash(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stash.keep(stage(spark, docs, sf_dir), name)
        if k:
            stash.drop(STAGES[k - 1][0])
    return docs
