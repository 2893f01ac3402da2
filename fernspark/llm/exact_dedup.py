"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

Every scan partition is a run: one entry per digest, with the smallest identifier and the number of rows, sorted by
digest. Runs are merged in binomial rounds of `fan_in` (a power of two): round k joins the runs whose numbers agree but
for the k-th group of bits. The runs of a group meet in an exchange on (group, digest), where each task holds one stretch
of digests of a group, sorts the stretches it was handed into one (what a merge of sorted stretches is in Spark) and walks
along it: of successive equal digests the first, which has the smallest identifier, is retained with the sum of the rows.
Equal means, at every level, equal SHA-256, byte length and a second, independent hash. No digest has more than `fan_in`
entries in a group, so a digest that holds a third of all rows weighs no more than another. At the root the one run is
dealt over all tasks by digest. The result goes back down to the leaves on (run, digest), so that such a digest is spread
over as many tasks as there were runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import staged

#: Runs that one merge takes in; a power of two.
FAN_IN = 16
KEY = ("__sha", "__len", "__check")


def normalised(text: Column) -> Column:
    """Null as empty; each run of 0x20 and 0x09-0x0D becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def merged(runs: DataFrame, fan_in: int) -> DataFrame:
    """__run, KEY, __keep, __size: the next level of runs, each sorted by KEY within its tasks."""
    smallest = F.col("__keep").asc_nulls_last()
    group = runs.withColumn("__run", F.floor(F.col("__run") / fan_in).cast("int"))
    lined_up = group.repartition("__run", *KEY).sortWithinPartitions("__run", *KEY, smallest)
    along = Window.partitionBy("__run", *KEY).orderBy(smallest)
    rows = F.sum("__size").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return lined_up.withColumns({"__rows": rows, "__place": F.row_number().over(along)}).filter("__place = 1").select("__run", *KEY, "__keep", F.col("__rows").alias("__size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space normalisation; null counts as empty, so null and empty texts are one
    group. The row with the smallest identifier stays. Null identifiers sort after all others; a group of null identifiers
    alone keeps a null keep_id and its rows are kept = true. Of repeated rows (same identifier and text) all have
    kept = true: identifiers, not rows, are told apart. An empty table gives an empty result. Other columns of docs are
    not looked at.
    """
    text = normalised(F.col(text_col))
    leaves = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), F.spark_partition_id().alias("__run"))
    leaves = leaves.select("__id", "__run", F.sha2("__text", 256).alias("__sha"), F.octet_length("__text").alias("__len"), F.xxhash64("__text").alias("__check"))
    leaves = staged(leaves, "digests")
    level = leaves.groupBy("__run", *KEY).agg(F.min("__id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
    last = leaves.agg(F.max("__run")).first()[0] or 0
    while last > 0:
        level, last = merged(level, fan_in), last // fan_in
    groups = level.filter("__size > 1").drop("__run")
    # Down again: each leaf run asks once for each of its digests.
    asked = leaves.select("__run", *KEY).distinct()
    told = asked.join(groups, list(KEY))
    kept = leaves.join(told, ["__run", *KEY], "left")
    keep = F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep"))
    return kept.select(
        F.col("__id").alias(id_col), keep.alias("keep_id"), F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"),
        F.col("__id").eqNullSafe(keep).alias("kept"), F.col("__sha").alias("text_sha256"),
    )
