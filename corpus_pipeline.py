"""A corpus pipeline: each stage keeps, rewrites or repeats documents, and hands its table to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import stages
from lodestone.scratch import scratch_path

STAGES = [
    ("quality rules", stages.quality_rules),
    ("line dedup", stages.line_dedup),
    ("simhash near-dedup", stages.simhash_dedup),
    ("mixing", stages.mixing),
    ("byte-level bpe", stages.byte_bpe),
]

#: Fuzzy line dedup and byte-level BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return made
        path = scratch_path(spark, f"stage{k}")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
