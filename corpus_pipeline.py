"""From raw documents to shards: five stages, each an operator of tesserae.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next.
All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import decontam, mixing, near_dup, quality, sharding
from tesserae.llm.common import Scratch, drop_made, made, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored under one half go."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-duplicates (five words, similarity 0.8): one document of each group stays."""
    return near_dup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edits allowed, go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Even shards with equal texts together."""
    return sharding.shard_linked(docs)


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Training and component search are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote is deleted once the next one's result is written.

    Defined cases are those of the operators; a stage that keeps nothing hands on an empty table.
    """
    docs, before = table(spark, sf_dir, "documents"), made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            scratch = Scratch(spark, f"pipeline-{name}")
            docs = scratch.cut(docs)
            drop_made(spark, [*before, scratch.at])
    return docs
