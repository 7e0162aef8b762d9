"""The corpus pipeline: from documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, decontaminate, line_dedup, quality, simhash_dedup
from docloom.llm.queries import BYTE_BPE
from docloom.llm.shared import cut, delete
from docloom.llm.tables import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))[0].select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier line has nearly word for word, and documents that have nothing else."""
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that overlap a test item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(docs, BYTE_BPE)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode_tokens),
]

#: No stage can be expressed in SQL; the tests hold what `run` gives against the stages done by brute force, text by text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through all stages; each stage's table is deleted when the next one's is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = cut(stage(spark, docs, sf_dir), name)
        if last:
            delete(spark, last)
        last = path
    return docs
