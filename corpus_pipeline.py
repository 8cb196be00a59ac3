"""A training-text pipeline over ``documents``.

Each stage works on all that the one before kept, written as Parquet and
read again: toxic documents go, repeated lines go, of near-duplicate
documents one stays, documents contaminated by ``benchmark`` go, and the
rest is encoded. All stages but the last return the columns of documents.

Rows of any stage may have nulls, empty or very long texts, ties and
repeats: null text is kept as it is and encodes to no ids; a null doc_id is
never dropped, as no decision names it; rows that repeat a doc_id are one
document and stay or go together; an empty table passes through empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from storeflow.llm import byte_bpe, decontamination, line_dedup, simhash_dedup, toxicity
from storeflow.llm.stages import Stage, documents, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of each group of fuzzily equal lines one occurrence stays."""
    return line_dedup.clean(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id."""
    return simhash_dedup.clean(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no (or too little) benchmark text."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and their number and digests, with a check by decoding."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("byte_bpe", encoded),
]

#: SimHash, components and byte-pair merges are beyond SQL; the stages are
#: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = Stage(step(spark, docs, sf_dir), f"pipeline-{name}").df
    return docs
