"""A corpus pipeline over `documents`: four stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillsift.llm.common import cut
from quillsift.llm.mixing import mixed
from quillsift.llm.packing import pack
from quillsift.llm.quality import keep_good
from quillsift.llm.simhash import drop_near_duplicates
from quillsift.plans.lineage import forget


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on docs and the labels table, rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of every document goes."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_dedup), ("mixing sources to target weights", mixing), ("best-fit packing", packing)]

#: SQL has no tokenizer, XXH64 or classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table in the shared folder, which goes when the next one stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            forget(spark, *before)
            before = [docs]
    return docs
