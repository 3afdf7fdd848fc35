"""The pipeline's stages: ``(spark, docs, sf_dir) -> docs``, each one operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import byte_bpe as bpe
from lodestone.llm.divergence import keep_good
from lodestone.llm.mixing import mix


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lodestone.llm.fuzzy_lines import dedup_lines

    return dedup_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lodestone.llm.simhash import keep_one

    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
