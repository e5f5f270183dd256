"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Any path that Spark can read; columns and filters are pruned at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """All tables as temporary views, for spark.sql()."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
