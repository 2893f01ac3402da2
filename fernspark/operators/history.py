"""Merges as a log of events, and the pets, links and photos that any point of the log stands for.

Nothing is overwritten by a merge: what a pet, a link or a photo was before stays in tables by original pet, and the log says
which pets stand for which. A state is folded from the log: the last event of each pet decides whether it is merged away,
and chains of merges (a into b, b into c) are followed to their end. To take a merge back is one more event, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import discard, staged
from .resolve import reconcile_status, survivors

#: Rounds of doubling after which a chain is taken for a circle: chains of up to 2 ** 40 merges end before.
ROUNDS = 40
#: Rows that a task takes in. Spark puts tasks together by compressed bytes, of which identifiers in order have next to none.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, by: str, *sized: DataFrame) -> DataFrame:
    """rows dealt out by a column over as many tasks as the rows of the largest of `sized` ask for; those should be plain tables, which are counted by their metadata."""
    most = max(df.count() for df in sized)
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // TASK_ROWS)), by)


def active_merges(log: DataFrame, upto: int | None = None) -> DataFrame:
    """loser, winner, seq of the merges that stand after event `upto` (None: all).

    log: seq, kind (merge, unmerge), loser, winner. An unmerge undoes the loser's last merge, whatever it has won or lost
    since; its winner is not looked at. An unmerge of a pet that is not merged does nothing.
    """
    seen = log if upto is None else log.filter(F.col("seq") <= upto)
    last = seen.groupBy("loser").agg(F.max_by(F.struct("kind", "winner", "seq"), "seq").alias("e"))
    return last.filter("e.kind = 'merge'").select("loser", "e.winner", "e.seq")


def owners(active: DataFrame) -> DataFrame:
    """pet_id, owner (at the end of its chain of merges) of every pet that is merged away; a staged table.

    Pointers double, so rounds grow with the logarithm of the longest chain. A circle is an error.
    """
    links = staged(active.select(F.col("loser").alias("pet_id"), F.col("winner").alias("owner")), "owners")
    for _ in range(ROUNDS):
        further = links.select(F.col("pet_id").alias("owner"), F.col("owner").alias("next"))
        new = staged(links.join(further, "owner", "left").select("pet_id", F.coalesce("next", "owner").alias("owner"), F.col("next").isNotNull().alias("moved")), "owners")
        discard(links)
        links = new.drop("moved")
        links._staged_at = new._staged_at
        if new.filter("moved").isEmpty():
            return links
    raise ValueError("the log merges pets in a circle")


def owned(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (pet_id, ...) by their owners."""
    o = found.select("pet_id", F.col("owner").alias("_owner"))
    return rows.join(o, "pet_id", "left").withColumn("pet_id", F.coalesce("_owner", "pet_id")).drop("_owner")


def state_at(log: DataFrame, upto: int | None, pets: DataFrame, links: DataFrame, photos: DataFrame, standing: DataFrame, registry: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pets, links and photos as they are after event `upto` of the log.

    pets: pet_id, status and any of the columns of resolve.survivors; links: pet_id, source, status, last_seen_at, ...;
    photos: pet_id, ...; all three by original pet. standing: pet_id, trust, last_seen, which rank the members of a pet
    after their owner. A pet that stands for several has their surviving facts, and the status that all its links give;
    others are as they were; those merged away are not there.
    """
    found = owners(active_merges(log, upto))
    sized = (links, photos)
    mine, pictures = (owned(dealt(x, "pet_id", *sized), found) for x in sized)
    members = found.select(F.col("owner").alias("winner"), F.col("pet_id").alias("node")).unionByName(found.select(F.col("owner").alias("winner"), F.col("owner").alias("node")).distinct())
    order = Window.partitionBy("winner").orderBy((F.col("node") != F.col("winner")).cast("int"), F.desc("trust"), F.desc("last_seen"), "node")
    ranked = members.join(standing.withColumnRenamed("pet_id", "node"), "node", "left").transform(dealt, "winner", *sized).withColumn("rank", F.row_number().over(order)).select("winner", "node", "rank")
    merged = survivors(ranked, pets).withColumnRenamed("winner", "pet_id")
    # Links of pets that stand for several are told by found, which is smaller than what survives of their facts.
    of_merged = dealt(mine, "pet_id", *sized).join(found.select(F.col("owner").alias("pet_id")), "pet_id", "left_semi")
    merged = merged.join(reconcile_status(of_merged, registry, as_of), "pet_id", "left").withColumn("status", F.coalesce("status", F.lit("removed")))
    rest = pets.join(members.select(F.col("node").alias("pet_id")), "pet_id", "left_anti").withColumn("members", F.lit(1).cast("long"))
    own = [c for c in pets.columns if c != "pet_id" and c not in merged.columns]
    whole = merged.join(pets.select("pet_id", *own), "pet_id", "left") if own else merged
    return whole.select(*rest.columns).unionByName(rest), mine, pictures
