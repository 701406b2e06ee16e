"""Five stages from raw documents to tokens; each works on all that its predecessor kept.

All but the last return the columns of documents, whatever these are called, and
an empty table for an empty one. Very long texts are read whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from strandline.llm.common import read, stored
from strandline.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go.

    A null text is scored like an empty one; repeated rows go or stay together.
    """
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays.

    Null and empty texts are equal; a null id is the smallest; of repeated rows one stays.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 or more the one with the smallest id stays.

    Texts without words are connected to nothing; a null id is the largest;
    repeated rows go or stay together.
    """
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go.

    Null texts contain nothing; repeated rows go or stay together; items without
    words are in no document.
    """
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; a null text has no tokens."""
    return bpe.encode(docs, vocabulary_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("decontaminate", drop_contaminated), ("bpe", encode)]

#: Learned scores and merge tables are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
