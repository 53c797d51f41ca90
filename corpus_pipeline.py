"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

Quality rules drop rejected documents and boilerplate lines; line dedup removes later equal or nearly equal lines
and the documents that consist of nothing else; the n-gram join keeps one document of each group of near
duplicates; substring dedup removes passages that occur more than once; packing lays the rest out in sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallywood.llm import curve_packing, line_dedup, ngram_join, quality_rules, substring_dedup
from tallywood.llm.common import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.apply_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.apply_removal(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curve_packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("substring dedup", passages), ("packing", packing)]
#: Hilbert order and token ids are beyond SQL; tests check columns, ids and least words, not each stage's rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves is dropped once the next one has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{top}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(before)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
