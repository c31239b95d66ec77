"""From raw documents to tokens: the stages of a training corpus.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, decontamination, language_id, near_duplicates, toxicity
from quarry.llm.common import held_out, read_table, written
from quarry.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language_id.keep_identified(docs, language_id.train(docs, where=~held_out()))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on those still here, does not reject."""
    return toxicity.keep_civil(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels"), where=~held_out()))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    return near_duplicates.keep_first(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and digests."""
    return bpe.encode(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("toxicity", remove_toxic),
    ("SimHash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("BPE encoding and decoding", tokenize),
]

#: Models and tokenization are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
