"""Parquet tables of a folder, as DataFrames and as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``text`` over the tables of ``sf_dir`` that it names."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in NAMES if "{" + n + "}" in text})
