"""From raw documents to token ids: five stages, each over all that the one before kept.

Each stage's result is written to the shared folder and read again, so a lost
executor costs the stage that it was in and no more. Once it is written, what the
stage read and wrote on the way goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, exact, mixing, near, quality
from millrace.llm.common import settled


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights and cut at the token budget."""
    return mixing.mixed_rows(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, token_ids, n_tokens, round_trips) of each document."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("BPE", bpe_encode),
]

#: SQL can express neither the trained classifier nor the sketches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(len(STAGES), spark, sf_dir)


def _after(k: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first ``k`` stages keep."""
    if not k:
        return spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = settled(lambda: _after(k - 1, spark, sf_dir), STAGES[k - 2][0].replace(" ", "-")) if k > 1 else _after(0, spark, sf_dir)
    return STAGES[k - 1][1](spark, docs, sf_dir)
