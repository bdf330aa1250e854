"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm import stages
from labelloom.llm.common import materialise, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("quality", stages.keep_quality),
    ("simhash_near_dedup", stages.near_dedup),
    ("decontamination", stages.decontaminated),
    ("byte_bpe", stages.encode),
]

#: SQL can express neither trained scores nor fingerprints; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
