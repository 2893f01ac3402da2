"""Snapshot sync: what changed between stored listings and a feed, and the next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import content_hash
from .normalize import VERSION as NORMALIZER_VERSION
from .resolve import reconcile_status

KEY = ("source", "site", "external_id")
#: Columns that are no part of a listing's content.
STATE_COLUMNS = ("status", "last_seen_at", "first_seen_at", "removed_at", "hash", "version", "ingest_order", "raw")


def last_of_batch(batch: DataFrame, order: str = "ingest_order") -> DataFrame:
    """One row per key, the last by ingest order (ties by content), with how many rows the key had."""
    if order not in batch.columns:
        return batch.withColumn("copies", F.lit(1).cast("long"))
    rest = [c for c in batch.columns if c not in (*KEY, order)]
    picked = batch.groupBy(*KEY).agg(F.max(F.struct(order, *rest)).alias("_r"), F.count(F.lit(1)).alias("copies"))
    return picked.select(*KEY, *(F.col(f"_r.{c}").alias(c) for c in rest), "copies")


def classify(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Full outer join on the key (site null-safe): s and b structs, and kind: new, changed, unchanged, reappeared, unseen.

    Content is compared by hash. A stored listing that was removed and comes again unchanged has reappeared.
    """
    batch = last_of_batch(batch)
    content = [c for c in batch.columns if c not in (*STATE_COLUMNS, "copies")]
    s = state.withColumn("hash", content_hash(state.select(*content))).select(F.struct("*").alias("s"))
    b = batch.withColumn("hash", content_hash(batch.select(*content))).select(F.struct("*").alias("b"))
    on = (F.col("s.source") == F.col("b.source")) & F.col("s.site").eqNullSafe(F.col("b.site")) & (F.col("s.external_id") == F.col("b.external_id"))
    kind = (
        F.when(F.col("s").isNull(), "new").when(F.col("b").isNull(), "unseen").when(F.col("s.hash") != F.col("b.hash"), "changed").when(F.col("s.status") == "removed", "reappeared").otherwise("unchanged")
    )
    return s.join(b, on, "full").withColumn("kind", kind)


def _complete(completed: list[str] | Column | None) -> Column:
    """Whether a stored listing's source was complete: one of a list, or by a column of its own (on s) where sources are many."""
    return F.lit(True) if completed is None else completed if isinstance(completed, Column) else F.col("s.source").isin(*completed)


def next_listings(classified: DataFrame, run_at: Column, completed: list[str] | Column | None = None, version: int = NORMALIZER_VERSION) -> DataFrame:
    """The next state: seen listings as the feed has them, unseen ones removed if their source's feed was complete (None: all were).

    first_seen_at is the stored one, or for new listings run_at; removed_at is set when a listing is removed, stays while it
    is unseen and is cleared when it comes again; version is the normalizer's for new and changed listings and stays for others.
    A state without first_seen_at, removed_at or version has nulls there.
    """
    c = F.col
    stored = {f.name for f in classified.schema["s"].dataType.fields}
    old = lambda n, kind: c(f"s.{n}") if n in stored else F.lit(None).cast(kind)
    seen = c("b").isNotNull()
    gone = (c("kind") == "unseen") & (c("s.status") != "removed") & _complete(completed)
    content = [f.name for f in classified.schema["b"].dataType.fields if f.name not in ("hash", "status", "copies")]
    return classified.select(
        *(F.when(seen, c(f"b.{n}")).otherwise(c(f"s.{n}")).alias(n) for n in content), F.when(seen, c("b.hash")).otherwise(c("s.hash")).alias("hash"),
        F.when(seen, c("b.status")).when(gone, "removed").otherwise(c("s.status")).alias("status"), F.when(seen, run_at).otherwise(c("s.last_seen_at")).alias("last_seen_at"),
        F.when(c("kind") == "new", run_at).otherwise(old("first_seen_at", "timestamp")).alias("first_seen_at"), F.when(gone, run_at).when(~seen, old("removed_at", "timestamp")).alias("removed_at"),
        F.when(c("kind").isin("new", "changed"), version).otherwise(old("version", "int")).alias("version"), "kind",
    )


def reproject(pets: DataFrame, listings: DataFrame, links: DataFrame, changed: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """pets with the status that all their listings give them, for the pets of changed listings; others stay.

    pets: pet_id, status, ...; listings: key, status, last_seen_at; links: key, pet_id; changed: keys, as changed_keys gives
    them, removed ones too. A pet is removed only if no source lists it any more.
    """
    on = lambda x, y: (x["source"] == y["_source"]) & x["site"].eqNullSafe(y["_site"]) & (x["external_id"] == y["_external_id"])
    l = links.select(*(F.col(k).alias(f"_{k}") for k in KEY), "pet_id")
    touched = changed.join(l, on(changed, l)).select("pet_id").distinct()
    every = l.join(touched, "pet_id", "left_semi")
    status = reconcile_status(listings.join(every, on(listings, every)).select("pet_id", "source", "site", "status", "last_seen_at"), registry, as_of)
    return pets.join(status.withColumnRenamed("status", "_status"), "pet_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def upsert_organizations(listings: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings with their organization_id, and the organisations that are new.

    listings: source, external_org_id, org_name, city, state, postcode, lat, lon, ...; refs: source, external_org_id,
    organization_id, one per known organisation of a source. A new one's id is a hash of source and external id, so that a
    rerun makes the same; of its listings the smallest row of values (nulls last) describes it, with a default name.
    """
    known = refs.select("source", "external_org_id", F.col("organization_id").cast("string").alias("_known"))
    made = F.sha1(F.concat_ws("|", "source", F.col("external_org_id").cast("string")))
    linked = listings.join(known, ["source", "external_org_id"], "left").withColumn("organization_id", F.coalesce("_known", made))
    about = ("org_name", "city", "state", "postcode", "lat", "lon")
    order = F.struct(*(x for c in about for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c).alias(c))))
    new = linked.filter("_known IS NULL").groupBy("organization_id", "source", "external_org_id").agg(F.min(order).alias("o"))
    new = new.select("organization_id", "source", "external_org_id", F.coalesce("o.org_name", F.lit("Unknown organization")).alias("name"), *(F.col(f"o.{c}").alias(c) for c in about[1:]))
    return linked.drop("_known"), new


def changed_keys(classified: DataFrame, completed: list[str] | Column | None = None) -> DataFrame:
    """Keys whose listing is new, changed, back, or now removed."""
    gone = (F.col("kind") == "unseen") & (F.col("s.status") != "removed") & _complete(completed)
    keys = [F.coalesce(f"b.{k}", f"s.{k}").alias(k) for k in KEY]
    return classified.filter(F.col("kind").isin("new", "changed", "reappeared") | gone).select(*keys, F.when(gone, "removed").otherwise(F.col("kind")).alias("change"))


def run_metrics(classified: DataFrame, quarantined: DataFrame, failed: list[str] = (), links: DataFrame | None = None) -> DataFrame:
    """source, fetched, duplicates, changed, removed (listings), removed_pets, quarantined, ok; a source that failed removes nothing.

    quarantined: source, n; links: key, pet_id, from which the distinct pets of removed listings are counted (without: null).
    """
    c = F.col
    n = lambda x: F.sum(x.cast("long"))
    gone = (c("kind") == "unseen") & (c("s.status") != "removed") & ~c("source").isin(*failed, "")
    runs = classified.withColumn("source", F.coalesce("b.source", "s.source")).groupBy("source").agg(
        n(c("b").isNotNull()).alias("fetched"), F.sum(F.coalesce(c("b.copies"), F.lit(1)) - 1).alias("duplicates"), n(c("kind").isin("new", "changed", "reappeared")).alias("changed"), n(gone).alias("removed")
    )
    pets = F.lit(None).cast("long")
    if links is not None:
        l = links.select(*(F.col(k).alias(f"_{k}") for k in KEY), "pet_id")
        on = (c("s.source") == c("_source")) & c("s.site").eqNullSafe(c("_site")) & (c("s.external_id") == c("_external_id"))
        lost = classified.withColumn("source", c("s.source")).filter(gone).join(l, on).groupBy("source").agg(F.count_distinct("pet_id").alias("removed_pets"))
        runs, pets = runs.join(lost, "source", "left"), F.coalesce("removed_pets", F.lit(0).cast("long"))
    runs = runs.withColumn("removed_pets", pets)
    out = runs.join(quarantined.select("source", F.col("n").alias("quarantined")), "source", "left")
    return out.withColumn("quarantined", F.coalesce("quarantined", F.lit(0).cast("long"))).withColumn("ok", ~c("source").isin(*failed, ""))


def project_pets(changed: DataFrame, links: DataFrame, pets: DataFrame) -> DataFrame:
    """Pets of changed listings (key, name, lat, lon): linked ones keep their id and, if the listing has none, their place; others get a new id.

    links: key, pet_id; pets: pet_id, lat, lon. New ids are hashes of the key, so a rerun makes the same ones.
    """
    l = links.select(*(F.col(k).alias(f"_{k}") for k in KEY), F.col("pet_id").alias("_pet"))
    on = (changed["source"] == l["_source"]) & changed["site"].eqNullSafe(l["_site"]) & (changed["external_id"] == l["_external_id"])
    made = F.sha1(F.concat_ws("|", "source", F.coalesce("site", F.lit("")), F.col("external_id").cast("string")))
    linked = changed.join(l, on, "left").withColumn("is_new", F.col("_pet").isNull()).withColumn("pet_id", F.coalesce(F.col("_pet").cast("string"), made))
    old = pets.select(F.col("pet_id").cast("string").alias("pet_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    placed = linked.join(old, "pet_id", "left")
    out = placed.withColumns({"lat": F.coalesce("lat", "_lat"), "lon": F.coalesce("lon", "_lon"), "match_method": F.when(F.col("is_new"), "exact_external_id")})
    return out.drop("_lat", "_lon", "_pet", *(f"_{k}" for k in KEY))


def replace_photos(old: DataFrame, new: DataFrame, taken_down: DataFrame, most: int = 6) -> DataFrame:
    """The next photos of listings that are fetched anew; photos of other listings stay.

    old: pet_id, listing_id, url, phash, is_primary, sort_order; new: pet_id, listing_id, urls; taken_down: url. Hashes are
    taken over from old photos with the same url that have one. Urls that were taken down stay out for good; the first of
    what is left is primary.
    """
    kept = old.join(new.select("listing_id").distinct(), "listing_id", "left_anti")
    urls = new.select("pet_id", "listing_id", F.posexplode(F.slice("urls", 1, most)).alias("k", "url")).join(taken_down.select("url").distinct(), "url", "left_anti")
    known = old.filter("phash <> ''").groupBy("listing_id", "url").agg(F.min("phash").alias("phash"))
    place = F.row_number().over(Window.partitionBy("listing_id").orderBy("k")) - 1
    fresh = urls.join(known, ["listing_id", "url"], "left").withColumn("sort_order", place)
    fresh = fresh.select("pet_id", "listing_id", "url", F.coalesce("phash", F.lit("")).alias("phash"), (F.col("sort_order") == 0).alias("is_primary"), "sort_order")
    return kept.select(*fresh.columns).unionByName(fresh)


def staleness_ceiling(listings: DataFrame, source: str, as_of: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Listings with those of one source unseen for longer than `days` removed, and an alert with their count if there are any."""
    old = (F.col("source") == source) & (F.col("last_seen_at") < as_of - F.make_interval(days=F.lit(days))) & (F.col("status") != "removed")
    swept = listings.withColumn("swept", old).withColumn("status", F.when(old, "removed").otherwise(F.col("status")))
    alert = listings.filter(old).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("staleness_ceiling").alias("kind"), F.lit(source).alias("source"), "n")
    return swept, alert


def sweep(listings: DataFrame, links: DataFrame, pets: DataFrame, registry: DataFrame, source: str, as_of: Column, days: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """staleness_ceiling, with the pets of swept listings reprojected over all their listings: listings, pets, alert."""
    swept, alert = staleness_ceiling(listings, source, as_of, days)
    after = reproject(pets, swept.drop("swept"), links, swept.filter("swept").select(*KEY), registry, as_of)
    return swept.drop("swept"), after, alert
