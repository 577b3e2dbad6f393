"""From raw documents to a sharded training corpus: five stages, each one operator of folioscope.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of documents;
the last adds each row's shard. Rows with null or empty text pass through like others unless a stage's own rule drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontaminate, mixing, neardup, quality, sharding
from folioscope.llm.common import discard, materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled rows among docs."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.distinct(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with the shard that it goes to."""
    placed = sharding.assign(docs)
    added = [c for c in placed.columns if c != "row"]
    named = {c: c + "_" * (c in docs.columns) for c in added}
    return placed.select("row.*", *[placed[c].alias(n) for c, n in named.items()])


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A trained classifier and sampled hash buckets have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it; what a stage read goes then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
