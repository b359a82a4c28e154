"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

All but the last return the columns of documents, others that a table may have included, whatever their names. What is written between
stages goes to the shared folder, and is deleted when the next stage is written. An empty table gives no rows in every stage; null
ids are ids like others, last in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import line_dedup, mixing, ngram_join, packing, quality
from quire.llm.common import fresh, remove, scratch, stash, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, those without words (null, empty) among them. Repeated rows go or stay together,
    and rows of equal score are told apart by a hash of id and text."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; so do documents of which nothing is left. Null and empty texts stay; rows equal in id and
    text are one document, and are edited alike."""
    return line_dedup.keep(docs)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; of repeated rows one. Documents without words are no
    copies of each other and stay."""
    return ngram_join.keep(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice. Documents without words stay once; repeated rows share their copies."""
    return mixing.keep(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, bucket, bucket_tokens, batch, place of each copy; texts without words have 0 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("ngram_join", join_stage), ("mixing", mix_stage), ("packing", pack_stage)]

#: No SQL: the classifier, the hash-based draws and the components are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = fresh(spark)
        with scratch(spark):  # what a stage writes for itself goes with it
            docs = stash(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
