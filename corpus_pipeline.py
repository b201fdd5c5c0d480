"""A corpus pipeline of five stages over ``documents``; part of the ``llm`` subpackage.

Each stage takes the documents that its predecessor kept.  All but the last return the
columns of ``documents``, whatever else they hold and under any names; the last returns the
packed pieces.

Defined results: null, empty and blank texts fail the first stage; a text that loses all its
lines in the second stays, as an empty one; of rows alike in doc_id and text, and of near
copies under one doc_id, one stays after the third; rows of a doc_id with different texts
are documents of their own in every stage; a null source is a source of its own; texts may
be of any length; empty tables give no pieces, an empty benchmark takes no document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontamination, line_dedup, minhash, packing, quality_rules
from strandlake.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and the documents that lose too much by it."""
    return quality_rules.clean_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate of a source goes from its documents."""
    return line_dedup.clean_documents(docs, host="source")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8 or more)."""
    return minhash.clean_documents(docs, size=5, threshold=80)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmarks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents", heavy=True)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: SQL has no tokenizer; tests/llm/test_cases.py compares the packed rows with a version of all five
#: stages in plain Python.
ORACLE_SQL = None
