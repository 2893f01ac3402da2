"""Tables written to the shared folder of the session, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. In local mode (tests) a temporary one is set where it is unset; a cluster's executors share no such folder, so there it must be named."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="fernspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._staged_at = at
    return out


class Scratch:
    """Staged tables that are deleted together."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(staged(df, name))
        return self.tables[-1]

    def discard(self) -> None:
        discard(*self.tables)
        self.tables = []


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more; what was derived from them must have been staged itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
