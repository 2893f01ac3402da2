"""Next-snapshot tables: Parquet parted by source, one folder per generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parted(df: DataFrame, part_by: str) -> DataFrame:
    """df with rows of one part in neighbouring tasks: a large part is cut by a hash of its rows, so no task has more than its share."""
    return df.repartitionByRange(part_by, F.xxhash64(*df.columns))


def write_snapshot(df: DataFrame, path: str, generation: int, part_by: str | None = "source") -> str:
    """Writes one generation of a table, rows of a source together; returns its folder."""
    at = f"{path}/generation={generation:08d}"
    writer = _parted(df, part_by) if part_by else df
    out = writer.write.mode("overwrite")
    (out.partitionBy(part_by) if part_by else out).parquet(at)
    return at


def read_snapshot(spark: SparkSession, path: str, generation: int, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/generation={generation:08d}")


def replace_sources(df: DataFrame, path: str, part_by: str = "source") -> None:
    """Overwrites the parts of the sources that df holds, and leaves the others."""
    _parted(df, part_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part_by).parquet(path)
