"""The corpus pipeline: documents to shards in five stages, each an operator of ``vecfold.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; between stages
the rows are written as Parquet below the shared folder and read again.
"""

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import vecfold
from vecfold.llm import decontamination, mixing, ngram_join, quality_rules, sharding
from vecfold.session import scratch_path

# Python workers get the package's functions with the task.
cloudpickle.register_pickle_by_value(vecfold)

SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules reject go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words a shingle, a similarity of 0.8."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources gain weight; a document may come several times or not at all."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shards of equal numbers, in random order."""
    return sharding.shard_rows(docs, SHARDS)


STAGES = [("quality", quality), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

# Learned rules and drawn shards have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
