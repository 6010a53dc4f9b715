"""The corpus pipeline: five operators in a row, each stage written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of docs.
Empty tables pass through; nulls, ties, repeated rows and further columns are treated as each operator's module says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evidex.llm import byte_bpe, line_dedup, mixing, simhash_dedup, toxicity
from evidex.llm.shared import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from labelled documents outside its held-out fold."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which no line stays."""
    return line_dedup.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies (five-word shingles, Jaccard similarity of 0.8 or more) the document with the smallest id stays."""
    return simhash_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights: a row for every document and epoch that takes of it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the decoded bytes, for every row."""
    return byte_bpe.encoded(docs, public_tokenizers.path(byte_bpe.VOCABULARY))


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_lines), ("simhash_dedup", drop_near_copies), ("mixing", mix_sources), ("byte_bpe", encode)]

#: SQL expresses neither the network nor the merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
