"""Corpus preparation: filter, drop near copies, cut repeats, remove secrets, pack.

Each stage takes the documents that the stage before it wrote, and all but the
last return the columns of `documents`, and any others the table has, whatever
their names.  Null text counts as empty, texts are taken whole however long,
and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathquarry.llm import jaccard_join, packing, quality_rules, secret_scan, suffix_dedup
from pathquarry.llm._common import Scratch, table


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; each row is judged by its own text, so null and empty texts go and rows without doc_id may stay."""
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays (of equal ones, by a hash of the text); those without doc_id come last.

    A document is a doc_id with a text: rows that repeat both stay together.
    Texts without words link with nothing and stay.
    """
    return jaccard_join.keep_one(docs, unnamed=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that start earlier in the corpus are cut out, with the characters they cut through.

    The corpus is ordered by doc_id, then by a hash of the text; rows without
    doc_id come last.  No row goes, though its text may become empty.
    """
    return suffix_dedup.cut_documents(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no row goes, and null text stays null."""
    return secret_scan.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048; an empty text is a piece that holds the separator."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", filter_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", remove_secrets),
    ("best-fit packing", pack_sequences),
]

#: Packing and the index have no SQL form; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs)
    return docs
