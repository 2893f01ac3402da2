"""The corpus pipeline: quality classifier, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents. Repeated rows of one doc_id are one document and
stay or go together; rows without a doc_id are scored, cut and packed, but never dropped as copies. An empty table stays
empty through all stages. Texts may be of any length; columns of docs may have any names but those that begin with `__`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernspark.llm import exact_dedup, minhash, packing, quality_classifier, substring_dedup
from fernspark.llm._spark import discard, staged


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs whose doc_id is not among `dropped` (doc_id)."""
    dropped = staged(dropped.select(F.col("doc_id").alias("__gone")).filter("__gone IS NOT NULL").distinct(), "dropped")
    few = dropped.count() <= 200_000  # 1.6 MB of identifiers
    return docs.join(F.broadcast(dropped) if few else dropped, docs["doc_id"] == dropped["__gone"], "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, accepts; without labels it rejects none."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model.weights is None:
        return docs
    own = {c: f"__own_{c}" for c in docs.columns if c in ("score", "predicted")}
    kept = quality_classifier.score(docs.withColumnsRenamed(own), model).filter("predicted = 1").drop("score", "predicted")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    return without(docs, exact_dedup.exact_dedup(docs).filter("NOT kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (a similarity of 0.8 or more) the document with the smallest doc_id."""
    return without(docs, minhash.near_duplicates(docs, percent=80).filter("NOT kept"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; those with no word left go."""
    return substring_dedup.cut_spans(docs, substring_dedup.repeated_passages(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_stage), ("exact_dedup", exact_stage), ("minhash_near_dedup", near_stage), ("substring_dedup", substring_stage), ("packing", packing_stage)]

#: Fits, chains and tokens are beyond SQL: each stage's operator is tested against a plain version, the whole with planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted when the next one's is written."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*done)
        done = [docs]
    return docs
