"""Streams: the report, sync and alert operators over arriving data.

Each stream keeps only what its batch twin needs: per pet the reporters since its last change, the last state of listings as
a snapshot table, or the runs so far as a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import ops, sync
from ..sources import landing
from ..staging import discard, staged


def report_counts(reports: DataFrame, least: int = 3) -> DataFrame:
    """A stream of pets with at least `least` distinct open reporters, from a stream of reports (pet_id, fingerprint, resolved).

    Update mode: a pet appears again as its count grows.
    """
    once = reports.filter(~F.col("resolved")).dropDuplicates(["pet_id", "fingerprint"])
    return once.groupBy("pet_id").agg(F.count(F.lit(1)).alias("reporters")).filter(F.col("reporters") >= least)


def run_reports(reports: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, least: int = 3) -> StreamingQuery:
    return report_counts(reports, least).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


#: Events of pets: reports (by a fingerprint), changes by a source (with the status it gives), and resolutions by an operator.
EVENTS = "pet_id long, kind string, fingerprint string, at timestamp, status string"
_KEPT = "pet_id long, changed_at timestamp, status string, alerted boolean, seen map<string,timestamp>"
DECISIONS = "pet_id long, reporters long, suppressed boolean, alert boolean, status string"
#: Parts that the pets of a stream of events are dealt to.
PET_BUCKETS = 32


def suppression_step(state: DataFrame, events: DataFrame, least: int = 3) -> DataFrame:
    """The state after some events, with a decision on each pet (reporters, suppressed, alert) and `here`: it had events.

    state: pet_id, changed_at, status, alerted, seen. A pet's state is the time and status of its last change, its reporters
    with the time of their last report since then, and whether an alert is open. Reports up to the last change (by their
    times, not by their arrival) do not count; a change resets, and so does a resolution, which also closes the alert.
    `suppressed`: at least `least` reporters count now; `alert`: the pet is suppressed and no alert was open; `status`: of
    the last change (null: none yet). Changes without a time are not looked at.
    """
    kind = F.col("kind")
    when = lambda test, c: F.when(test, c)
    reporter = when((kind == "report") & F.col("fingerprint").isNotNull(), F.col("fingerprint"))
    change = when((kind == "change") & F.col("at").isNotNull(), F.struct("at", "status"))
    # A reporter's reports first, so that one who reports often is one entry.
    by_reporter = events.groupBy("pet_id", reporter.alias("who")).agg(F.max("at").alias("at"), F.max(change).alias("change"), F.max(when(kind.isin("change", "resolve"), F.col("at"))).alias("moved_at"), F.max(F.coalesce(kind == "resolve", F.lit(False))).alias("resolved"))
    entries = F.collect_list(when(F.col("who").isNotNull(), F.struct("who", "at")))
    fresh = by_reporter.groupBy(F.col("pet_id").alias("_pet")).agg(F.map_from_entries(entries).alias("fresh"), F.max("change").alias("change"), F.max("moved_at").alias("moved_at"), F.max("resolved").alias("resolved"), F.lit(True).alias("here"))
    x = state.join(fresh, F.col("pet_id").eqNullSafe(F.col("_pet")), "full_outer")
    none = F.create_map().cast("map<string,timestamp>")
    both = F.map_zip_with(F.coalesce("seen", none), F.coalesce("fresh", none), lambda _, old, new: F.greatest(old, new))
    newer = F.col("change").isNotNull() & (F.col("changed_at").isNull() | (F.col("change.at") > F.col("changed_at")))
    x = x.select(
        F.coalesce("pet_id", "_pet").alias("pet_id"), F.greatest("changed_at", "moved_at").alias("changed_at"), F.when(newer, F.col("change.status")).otherwise(F.col("status")).alias("status"),
        (F.coalesce("alerted", F.lit(False)) & ~F.coalesce("resolved", F.lit(False))).alias("open"), both.alias("seen"), F.coalesce("here", F.lit(False)).alias("here"),
    )
    x = x.withColumn("seen", F.map_filter("seen", lambda _, at: F.col("changed_at").isNull() | (at > F.col("changed_at"))))
    x = x.withColumn("reporters", F.size("seen").cast("long")).withColumn("suppressed", F.col("reporters") >= least)
    x = x.withColumn("alert", F.col("here") & F.col("suppressed") & ~F.col("open"))
    return x.select("pet_id", "changed_at", "status", (F.col("open") | F.col("alert")).alias("alerted"), "seen", "reporters", "suppressed", "alert", "here")


def run_suppression(events: DataFrame, path: str, checkpoint: str, least: int = 3, buckets: int = PET_BUCKETS) -> StreamingQuery:
    """Writes each micro-batch's decisions (one per pet that had events) from a stream of EVENTS to a part of its own under `path` (batch=n).

    The state lies beside them (_state), pets dealt to slots, with a manifest as run_sync has: a micro-batch reads and writes
    the slots that its pets fall into. Repeated after a failure, it overwrites its own folders.
    """
    at = f"{path}/_state"
    slotted = lambda df: df.withColumn("slot", F.pmod(F.xxhash64("pet_id"), F.lit(buckets)).cast("string"))

    def apply(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        slots = _manifest(spark, at, number) if number else {}
        last = set(_folders(at, _manifest(spark, at, number - 1))) if number > 1 else set()
        hit = {r["slot"] for r in slotted(batch.select("pet_id")).select("slot").distinct().collect()}  # `buckets` rows at most
        touched = {k: v for k, v in slots.items() if k in hit}
        state = spark.read.schema(_KEPT).parquet(*_folders(at, touched)) if touched else spark.createDataFrame([], _KEPT)
        folder = f"{at}/data/batch={number + 1:08d}"
        after = suppression_step(state, batch, least)
        slotted(after).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(folder)
        made = spark.read.schema(after.schema).parquet(folder)
        made.filter("here").select(*(f.name for f in T._parse_datatype_string(DECISIONS))).write.mode("overwrite").parquet(f"{path}/batch={number}")
        _write_manifest(spark, at, number + 1, slots | {k: ("", number + 1) for k in hit})
        _delete(spark, sorted(last - set(_folders(at, slots))))

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """All decisions so far, with their batch."""
    return spark.read.schema(f"{DECISIONS}, batch int").option("basePath", path).parquet(path)


def suppressed_pets(pets: DataFrame, decided: DataFrame) -> DataFrame:
    """pets (pet_id, status, ...) by the last decision on each: suppressed ones are removed, others have the status of their last change, or their own."""
    last = decided.groupBy("pet_id").agg(F.max_by(F.struct("suppressed", "status"), "batch").alias("_d"))
    both = pets.join(last, "pet_id", "left")
    return both.withColumn("status", F.when(F.col("_d.suppressed"), "removed").otherwise(F.coalesce("_d.status", "status"))).drop("_d")


def sync_batch(state: DataFrame, batch: DataFrame, run_at, completed: list[str] | Column) -> tuple[DataFrame, DataFrame]:
    """The next state and the changed keys of one landed batch; sources not in `completed` lose nothing."""
    classified = sync.classify(state, batch)
    return sync.next_listings(classified, run_at, completed), sync.changed_keys(classified, completed)


#: Parts that the listings of one source are dealt to; groups that the sources of a feed of payloads are dealt to.
BUCKETS, GROUPS = 8, 64
MANIFEST = "slot string, source string, batch int"


def _owner(groups: int | None) -> Column:
    """What a slot belongs to: a source, or, where sources may be many, one of some groups of sources."""
    return F.col("source") if groups is None else F.concat(F.pmod(F.xxhash64("source"), F.lit(groups)).cast("string"), F.lit(f" of {groups}"))


def _slots(df: DataFrame, buckets: int, groups: int | None = None) -> DataFrame:
    """df with slot: its owner and a part of the owner's keys, as the name of a folder."""
    part = F.pmod(F.xxhash64(*(["source"] if groups else []), F.coalesce("site", F.lit("")), F.col("external_id").cast("string")), F.lit(buckets))
    return df.withColumn("slot", F.concat(F.lower(F.hex(F.xxhash64(_owner(groups)))), F.lit("-"), part.cast("string")))


def _manifest(spark: SparkSession, path: str, number: int) -> dict[str, tuple[str, int]]:
    """slot: (owner, batch that wrote it) of one generation; sources, or their groups, times BUCKETS rows at most."""
    return {r["slot"]: (r["source"], r["batch"]) for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest={number:08d}").collect()}


def _write_manifest(spark: SparkSession, path: str, number: int, slots: dict[str, tuple[str, int]]) -> None:
    rows = [(slot, source, batch) for slot, (source, batch) in sorted(slots.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest={number:08d}")


def _folders(path: str, slots: dict[str, tuple[str, int]]) -> list[str]:
    return [f"{path}/data/batch={batch:08d}/slot={slot}" for slot, (_, batch) in sorted(slots.items())]


def _write_slots(df: DataFrame, path: str, batch: int, buckets: int, groups: int | None = None) -> dict[str, tuple[str, int]]:
    """Writes rows by slot to a folder of this batch; the slots written."""
    spark, at = df.sparkSession, f"{path}/data/batch={batch:08d}"
    _slots(df, buckets, groups).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(at)
    found = spark.read.schema(f"{df.select('source').schema[0].simpleString().replace(':', ' ')}, slot string").parquet(at).select("slot", _owner(groups).alias("owner")).distinct().collect()
    return {r["slot"]: (r["owner"], batch) for r in found}


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for at in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_state(spark: SparkSession, path: str, schema: T.StructType, number: int) -> DataFrame:
    """The state after `number` micro-batches."""
    folders = _folders(path, _manifest(spark, path, number))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _apply_lot(path: str, number: int, rows: DataFrame, at, done: list[str] | DataFrame, schema: T.StructType, buckets: int, groups: int | None = None) -> None:
    """Writes generation number + 1: rows of a lot that ran at `at` (None: an empty one), in which the sources `done` (with groups: a table) are complete."""
    spark: SparkSession = rows.sparkSession
    slots = _manifest(spark, path, number)
    if groups is not None and any(not owner.endswith(f" of {groups}") for owner, _ in slots.values()):
        raise ValueError(f"the state under {path} was not kept by {groups} groups of sources")
    last = set(_folders(path, _manifest(spark, path, number - 1))) if number else set()
    fresh: dict[str, tuple[str, int]] = {}
    if at is not None:
        hit = {r["slot"] for r in _slots(rows.select(*sync.KEY), buckets, groups).select("slot").distinct().collect()}  # sources or groups times buckets
        whole = set(done) if groups is None else {r["owner"] for r in done.select(_owner(groups).alias("owner")).distinct().collect()}
        touched = {k: v for k, v in slots.items() if k in hit or v[0] in whole}
        state = spark.read.schema(schema).parquet(*_folders(path, touched)) if touched else spark.createDataFrame([], schema)
        completed = done
        if groups is not None:
            state, completed = state.join(done.select("source", F.lit(True).alias("_complete")), "source", "left"), F.coalesce("s._complete", F.lit(False))
        after, _ = sync_batch(state, rows, F.lit(at), completed)
        fresh = _write_slots(after.select(*(F.col(f.name).cast(f.dataType) for f in schema)), path, number + 1, buckets, groups)
    _write_manifest(spark, path, number + 1, slots | fresh)
    _delete(spark, sorted(last - set(_folders(path, slots))))


def run_sync(feed: DataFrame, path: str, checkpoint: str, first_state: DataFrame | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Applies landed feed rows (key, content, status, run_at, complete) to a snapshot table under `path`, kept by slots.

    A slot is a part of one source's listings. A micro-batch reads the slots of its sources (of a source whose feed is not
    complete only those that its rows fall into), writes them anew to a folder of its own, and a manifest: which batch
    wrote each slot. Other slots are carried over by name. Repeated after a failure, a batch overwrites its own folder and
    manifest. Slots that neither the last manifest nor the one before names are deleted. `complete` marks rows of a source
    whose whole feed has landed: only then are its unseen listings removed. first_state (key, content, status, last_seen_at,
    first_seen_at, removed_at, version) is manifest 0; None where the stream goes on. State is read with state_schema.
    """
    schema = state_schema(feed)
    columns = [c for c in feed.columns if c not in ("run_at", "complete")]
    if first_state is not None:
        first = first_state.select(*(F.col(f.name).cast(f.dataType) for f in schema))
        _write_manifest(first.sparkSession, path, 0, _write_slots(first, path, 0, buckets))

    def apply(batch: DataFrame, number: int) -> None:
        at = batch.agg(F.max("run_at")).first()[0]
        done = [r["source"] for r in batch.filter("complete").select("source").distinct().collect()]  # one row per source
        _apply_lot(path, number, batch.select(*columns), at, done, schema, buckets)

    return feed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def _generations(spark: SparkSession, path: str) -> int:
    """How many generations of the state are whole."""
    n, hadoop = 0, spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    while system.exists(hadoop(f"{path}/manifest={n:08d}/_SUCCESS")):
        n += 1
    return n


def run_feed(spark: SparkSession, landed: str, path: str, quarantine: str, checkpoint: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], first_state: DataFrame | None = None, buckets: int = BUCKETS, groups: int = GROUPS) -> StreamingQuery:
    """Applies a folder of landed payloads (sources.landing) to a snapshot table, and parts off what fails.

    The table is kept as run_sync does, but a slot is a part of a group of sources: of any number of sources there are as
    many slots as groups times buckets, and a lot in which a source is complete reads and writes the slots of its group.
    No list of sources comes to the driver.

    parse: a lot's rows to good listings (key, content, status; one row per key) and a quarantine with a column `reasons`, in
    which a payload that could not be read as a whole has external_id null and a reason that begins with 'payload'. Such a
    source is not complete in that lot: its good listings count, but nothing of it is removed. A complete source without
    payloads loses all. Lots of one micro-batch are applied one after the other; generation n + 1 is the state after lot n.
    A lot's quarantine is written to lot=n before its generation, and a repeated micro-batch passes over lots whose
    generation is whole, so each lot counts once. first_state: as in run_sync.
    """
    rows = landing.landed_stream(spark, landed)
    schema = state_schema(parse(landing.landed(spark, landed, 0, 0))[0])
    if not _generations(spark, path):
        first = spark.createDataFrame([], schema) if first_state is None else first_state.select(*(F.col(f.name).cast(f.dataType) for f in schema))
        _write_manifest(spark, path, 0, _write_slots(first, path, 0, buckets, groups))

    def apply(batch: DataFrame, _: int) -> None:
        batch.persist()  # payload files are read once; lost blocks are read again
        lots = {r["lot"]: r["at"] for r in batch.groupBy("lot").agg(F.max("run_at").alias("at")).collect()}
        for lot in sorted(set(lots) - set(range(_generations(spark, path) - 1))):
            one = batch.filter(F.col("lot") == lot)
            good, bad = parse(one)
            good = staged(good, "lot")
            bad.write.mode("overwrite").parquet(f"{quarantine}/lot={lot}")
            failed = spark.read.schema(bad.schema).parquet(f"{quarantine}/lot={lot}").filter(F.col("external_id").isNull() & F.exists("reasons", lambda r: r.startswith("payload")))
            whole = one.filter("complete").select("source").distinct().join(failed.select(F.col("source_id").alias("source")).distinct(), "source", "left_anti")
            whole = staged(whole, "whole-sources")
            _apply_lot(path, lot, good, lots[lot], whole, schema, buckets, groups)
            discard(good, whole)
        batch.unpersist()

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def state_schema(feed: DataFrame) -> T.StructType:
    """Columns of the state that run_sync keeps for a feed."""
    added = [("status", "string"), ("last_seen_at", "timestamp"), ("first_seen_at", "timestamp"), ("removed_at", "timestamp"), ("version", "int")]
    content = [f for f in feed.schema if f.name not in ("run_at", "complete", *(n for n, _ in added))]
    return T.StructType([*(T.StructField(n, T._parse_datatype_string(t)) for n, t in added), *(T.StructField(f.name, f.dataType) for f in content)])


def run_alerts(runs: DataFrame, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Count-drop and validation alerts for sources with new runs, each batch with what all earlier ones have told.

    Under `path` lie the successful runs by day (day=d/batch=n), of which a batch reads the days that its 7 days touch, and the latest
    successful run of each source (latest/batch=n), made from that of the batch before. So what a batch reads does not
    grow with the history. Both are overwritten by a batch that is repeated after a failure; runs that come again (source,
    run_id) count once. That a source is dark needs a clock, not an event: ops.source_dark runs on a schedule.
    """
    latest_at = lambda n: f"{path}/latest/batch={n}"
    kept = T.StructType([T.StructField("day", T.DateType()), T.StructField("batch", T.IntegerType())])

    def apply(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        dated = batch.filter("ok AND finished_at IS NOT NULL").select(*runs.columns, F.to_date("finished_at").alias("day"), F.lit(number).alias("batch"))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/days")
        before = spark.read.schema(runs.schema).parquet(latest_at(number - 1)) if number else batch.limit(0)
        ops.latest_ok(before.unionByName(batch)).select(*runs.columns).write.mode("overwrite").parquet(latest_at(number))
        now = batch.agg(F.max("finished_at")).first()[0]
        if now is None:
            return
        every = spark.read.schema(T.StructType([*runs.schema.fields, *kept.fields])).parquet(f"{path}/days")
        week = every.filter((F.col("day") >= F.date_sub(F.to_date(F.lit(now)), 7)) & (F.col("day") <= F.to_date(F.lit(now))) & (F.col("batch") <= number)).dropDuplicates(["source", "run_id"])
        latest = spark.read.schema(runs.schema).parquet(latest_at(number))
        nothing = latest.select("source").limit(0)
        drop = ops.count_drop(week, F.lit(now), nothing, latest=latest).select("kind", "source")
        bad = ops.validation_failures(latest, nothing).select("kind", "source")
        sink(drop.unionByName(bad).join(batch.select("source").distinct(), "source", "left_semi"), number)

    return runs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()
