"""Reading the tables that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..staging import Scratch, discard, shared_dir, staged

__all__ = ["Scratch", "discard", "documents", "shared_dir", "staged"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
