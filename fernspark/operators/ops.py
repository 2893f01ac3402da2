"""Operations: alerts on runs, reports, takedowns, source termination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import object_key
from .resolve import reconcile_status


def latest_ok(runs: DataFrame) -> DataFrame:
    """The latest successful run of each source; ties by run_id."""
    columns = [c for c in runs.columns if c != "source"]
    best = runs.filter("ok").groupBy("source").agg(F.max_by(F.struct(*columns), F.struct("finished_at", "run_id")).alias("r"))
    return best.select("source", "r.*")


def source_dark(sources: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Sources (source, interval_s) without a successful run in the last two intervals."""
    last = latest_ok(runs).select("source", "finished_at")
    late = F.col("finished_at").isNull() | (F.unix_micros(as_of) - F.unix_micros(F.col("finished_at").cast("timestamp")) > F.col("interval_s").cast("long") * 2_000_000)
    return sources.join(last, "source", "left").filter(late).select("source", F.lit("source_dark").alias("kind"), "finished_at")


def count_drop(runs: DataFrame, as_of: Column, dark: DataFrame, share: float = 0.6, latest: DataFrame | None = None) -> DataFrame:
    """Sources whose latest run fetched less than `share` of the median of the last 7 days; dark ones are left out.

    latest: the latest successful run of each source, where it is known already and runs are those of the last 7 days only.
    """
    week = runs.filter(F.col("ok") & (F.col("finished_at") > as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("finished_at") <= as_of))
    median = week.groupBy("source").agg(F.percentile("fetched", 0.5).alias("median"))
    last = (latest_ok(runs) if latest is None else latest).join(dark.select("source"), "source", "left_anti").select("source", "fetched")
    return last.join(median, "source").filter((F.col("median") > 0) & (F.col("fetched") < share * F.col("median"))).select("source", F.lit("count_drop").alias("kind"), "fetched", "median")


def validation_failures(runs: DataFrame, dark: DataFrame, limit: float = 0.1) -> DataFrame:
    """Sources whose latest run quarantined more than `limit` of what it saw."""
    last = latest_ok(runs).join(dark.select("source"), "source", "left_anti")
    total = F.col("fetched") + F.col("quarantined")
    rate = F.when(total > 0, F.col("quarantined") / total).otherwise(0.0)
    return last.filter(rate > limit).select("source", F.lit("validation_failures").alias("kind"), F.round(rate, 3).alias("rate"))


def new_alerts(found: DataFrame, open_alerts: DataFrame) -> DataFrame:
    """Alerts (kind, source, ...) of which none is open yet; the source may be null."""
    o = open_alerts.select(F.col("kind").alias("_kind"), F.col("source").alias("_source")).distinct()
    return found.join(o, (found["kind"] == o["_kind"]) & found["source"].eqNullSafe(o["_source"]), "left_anti")


def report_suppression(reports: DataFrame, changed: DataFrame | None = None, least: int = 3) -> DataFrame:
    """Pets with at least `least` distinct open reporters: pet_id, reporters, first_at, last_at; they are to be removed, with one open alert each.

    changed: pet_id, changed_at; only reports after a pet's last change count.
    """
    valid = reports.filter(~F.col("resolved"))
    if changed is not None:
        valid = valid.join(changed.select("pet_id", "changed_at"), "pet_id", "left").filter(F.col("changed_at").isNull() | (F.col("created_at") > F.col("changed_at")))
    once = valid.groupBy("pet_id", "fingerprint").agg(F.min("created_at").alias("at"))
    return once.groupBy("pet_id").agg(F.count(F.lit(1)).alias("reporters"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).filter(F.col("reporters") >= least)


def suppress(pets: DataFrame, reported: DataFrame, open_alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pets (pet_id, status, ...) with reported ones removed, and an alert for each that was not removed before and has none open.

    reported: as report_suppression gives it; open_alerts: pet_id of open alerts of that kind.
    """
    r = reported.select("pet_id", "reporters")
    both = pets.join(r, "pet_id", "left")
    fresh = both.filter("reporters IS NOT NULL AND status <> 'removed'").join(open_alerts.select("pet_id").distinct(), "pet_id", "left_anti")
    after = both.withColumn("status", F.when(F.col("reporters").isNotNull(), "removed").otherwise(F.col("status"))).drop("reporters")
    return after, fresh.select(F.lit("user_reports").alias("kind"), "pet_id", "reporters")


def takedown(photos: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos without those of the given urls, and the names of the stored objects to delete."""
    gone = urls.select("url").distinct()
    return photos.join(gone, "url", "left_anti"), photos.join(gone, "url", "left_semi").select("url").distinct().select("url", object_key(F.col("url")).alias("object"))


def terminate_source(links: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Links without those of a source, and the pets that lost one: pet_id, links_left (0: the pet goes)."""
    lost = links.filter(F.col("source") == source).select("pet_id").distinct()
    rest = links.filter(F.col("source") != source)
    left = rest.groupBy("pet_id").agg(F.count(F.lit(1)).alias("links_left"))
    return rest, lost.join(left, "pet_id", "left").select("pet_id", F.coalesce("links_left", F.lit(0).cast("long")).alias("links_left"))


def survivors_of_termination(pets: DataFrame, links: DataFrame, source: str, registry: DataFrame, as_of: Column) -> DataFrame:
    """pets (pet_id, status, ...) after a source goes: those that it listed get the status that their other listings give them, and go if they have none."""
    rest, lost = terminate_source(links, source)
    status = reconcile_status(rest.join(lost.select("pet_id"), "pet_id", "left_semi"), registry, as_of).withColumnRenamed("status", "_status")
    left = pets.join(lost, "pet_id", "left").filter("links_left IS NULL OR links_left > 0").join(status, "pet_id", "left")
    return left.withColumn("status", F.coalesce("_status", "status")).drop("_status", "links_left")
