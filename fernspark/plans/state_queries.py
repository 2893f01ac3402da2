"""Registered queries of sync, operations and user features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import fingerprint
from ..operators import ops, profiles, sync
from .search_queries import _BORDER_SQL, _MILES
from .views import view, with_views

RUN_AT = "1999-01-01 00:00:00"
COMPLETED = ["src0", "src1", "src2", "src3", "src4"]
LINKS_AS_OF = "2001-11-05 00:00:00"
INTERVAL_S = 6 * 3600


def _at(text: str):
    return F.lit(text).cast("timestamp")


def _classified(spark, sf_dir) -> DataFrame:
    return sync.classify(view(spark, sf_dir, "state"), view(spark, sf_dir, "batch"))


def sync_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select(F.coalesce("b.external_id", "s.external_id").alias("external_id"), "kind")


def sync_next_listings(spark, sf_dir):
    out = sync.next_listings(_classified(spark, sf_dir), _at(RUN_AT), COMPLETED)
    return out.select("source", "site", "external_id", F.round("fee", 2).alias("fee"), "status", "last_seen_at", "first_seen_at", "removed_at", "version")


def _registry(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "state").select("source").distinct().withColumn("interval_s", F.lit(86400))


def sync_reproject(spark, sf_dir):
    """Pets of two listings each after the run: those of changed and removed listings get their status anew."""
    c = _classified(spark, sf_dir)
    after = sync.next_listings(c, _at(RUN_AT), COMPLETED)
    pet = F.floor(F.col("external_id") / 2).alias("pet_id")
    orders = view(spark, sf_dir, "listings").select(F.floor(F.col("pet_id") / 2).alias("pet_id")).distinct()
    pets = orders.withColumn("status", F.when(F.col("pet_id") % 5 == 0, "pending").otherwise("available"))
    links = after.select(*sync.KEY, pet)
    return sync.reproject(pets, after, links, sync.changed_keys(c, COMPLETED), _registry(spark, sf_dir), _at(RUN_AT)).select("pet_id", "status")


def org_upsert(spark, sf_dir):
    """Listings of organisations of which two thirds are known, with the names of new ones."""
    o = F.col("org_id")
    listed = view(spark, sf_dir, "listings").select("pet_id", F.concat(F.lit("src"), (o % 6).cast("string")).alias("source"), o.alias("external_org_id"), F.when(F.col("pet_id") % 4 == 0, F.concat(F.lit("Org "), o.cast("string"))).alias("org_name"), "city", F.lit("CA").alias("state"), F.lit(None).cast("string").alias("postcode"), "lat", "lon")
    refs = view(spark, sf_dir, "orgs").filter("org_id % 3 <> 0").select("source", o.alias("external_org_id"), o.alias("organization_id"))
    linked, new = sync.upsert_organizations(listed, refs)
    about = new.select("organization_id", F.col("name").alias("new_name"), F.col("city").alias("new_city"), F.round("lat", 6).alias("new_lat"))
    return linked.select("pet_id", "organization_id").join(about, "organization_id", "left")


def sync_suppress_unseen(spark, sf_dir):
    out = sync.next_listings(_classified(spark, sf_dir), _at(RUN_AT), COMPLETED)
    return out.filter("removed_at IS NOT NULL").select("source", "external_id", "removed_at")


def sync_changed_keys(spark, sf_dir):
    return sync.changed_keys(_classified(spark, sf_dir), COMPLETED)


def sync_run_metrics(spark, sf_dir):
    bad = view(spark, sf_dir, "runs").groupBy(F.concat(F.lit("src"), (F.col("run_id") % 6).cast("string")).alias("source")).agg(F.sum("quarantined").alias("n"))
    state = view(spark, sf_dir, "state")
    return sync.run_metrics(_classified(spark, sf_dir), bad, ["src5"], state.select("source", "site", "external_id", F.floor(F.col("external_id") / 40).alias("pet_id")))


def sync_project_pets(spark, sf_dir):
    """Changed listings; those of orders divisible by 3 are linked already, and only even ones say where they are."""
    changed = sync.changed_keys(_classified(spark, sf_dir), COMPLETED)
    places = view(spark, sf_dir, "listings").select("pet_id", "lat", "lon")
    e = F.col("external_id")
    new = changed.join(places.withColumnRenamed("pet_id", "external_id"), "external_id").withColumns({c: F.when(e % 2 == 0, F.col(c) + 1) for c in ("lat", "lon")})
    links = view(spark, sf_dir, "state").filter(e % 3 == 0).select("source", "site", "external_id", (e + 1).alias("pet_id"))
    out = sync.project_pets(new, links, places)
    return out.select("external_id", F.when(~F.col("is_new"), F.col("pet_id")).otherwise("new").alias("pet"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "match_method")


def sync_photo_replace(spark, sf_dir):
    p = view(spark, sf_dir, "photos")
    old = p.select("pet_id", F.concat_ws("-", "pet_id", F.col("sort_order") % 2).alias("listing_id"), "url", F.when(F.col("l_partkey") % 2 == 0, F.md5("url")).otherwise("").alias("phash"), "is_primary", "sort_order")
    new = p.filter("pet_id % 4 = 0 AND sort_order % 2 = 0").groupBy("pet_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    new = new.select("pet_id", F.concat(F.col("pet_id").cast("string"), F.lit("-0")).alias("listing_id"), F.concat(F.array(F.concat(F.lit("https://img.example/new-"), F.col("pet_id").cast("string"))), "urls").alias("urls"))
    taken = p.filter("l_partkey % 10 = 3").select("url")
    return sync.replace_photos(old, new, taken, 3).select("listing_id", "url", "phash", "is_primary", "sort_order")


def staleness_ceiling(spark, sf_dir):
    swept, alert = sync.staleness_ceiling(view(spark, sf_dir, "links"), "src3", _at(LINKS_AS_OF), 1500)
    counts = swept.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(alert.select("source", F.concat(F.lit("alert:"), "kind").alias("status"), "n"))


def staleness_pets(spark, sf_dir):
    """Pets of two listings each after a sweep of one source, whose intervals differ by site."""
    listings = view(spark, sf_dir, "state").withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp"))
    links = listings.select("source", "site", "external_id", F.floor(F.col("external_id") / 2).alias("pet_id"))
    pets = links.select("pet_id", F.lit("listed").alias("status")).distinct()
    days = [("src3", "a0", 1), ("src3", "a1", 200), ("src0", None, 300)]
    registry = spark.createDataFrame([(s, x, 86400 * d) for s, x, d in days], "source string, site string, interval_s long")
    return sync.sweep(listings, links, pets, registry, "src3", _at("1996-01-01 00:00:00"), 900)[1].select("pet_id", "status")


def _sources(runs: DataFrame) -> DataFrame:
    return runs.select("source").distinct().withColumn("interval_s", F.lit(INTERVAL_S))


def source_dark(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    return ops.source_dark(_sources(runs), runs, _at("2024-02-01 00:00:00"))


def _alerts(spark, sf_dir):
    runs, now = view(spark, sf_dir, "runs"), _at("2024-01-31 00:00:00")
    dark = ops.source_dark(_sources(runs), runs, now)
    return dark, ops.count_drop(runs, now, dark), ops.validation_failures(runs, dark)


def count_drop(spark, sf_dir):
    return _alerts(spark, sf_dir)[1]


def validation_failures(spark, sf_dir):
    return _alerts(spark, sf_dir)[2]


def open_alerts(spark, sf_dir):
    """New alerts, where for sources in the first half of the alphabet a count drop is open already."""
    dark, drop, bad = (x.select("kind", "source") for x in _alerts(spark, sf_dir))
    known = view(spark, sf_dir, "runs").filter("source < 'm'").select(F.lit("count_drop").alias("kind"), "source").distinct()
    return ops.new_alerts(dark.unionByName(drop).unionByName(bad), known)


def report_suppression(spark, sf_dir):
    changed = view(spark, sf_dir, "listings").filter("pet_id % 5 = 0").select("pet_id", F.lit("2024-01-10 00:00:00").cast("timestamp").alias("changed_at"))
    return ops.report_suppression(view(spark, sf_dir, "reports"), changed)


def report_removal(spark, sf_dir):
    """Pets after the reports, and the alerts that are new where every fourth pet has one open."""
    pets = view(spark, sf_dir, "listings").select("pet_id", "status")
    known = pets.filter("pet_id % 4 = 0").select("pet_id")
    after, alerts = ops.suppress(pets, report_suppression(spark, sf_dir), known)
    return after.select("pet_id", "status").unionByName(alerts.select("pet_id", F.concat_ws(" ", "kind", F.col("reporters").cast("string")).alias("status")))


def report_fingerprints(spark, sf_dir):
    return view(spark, sf_dir, "reports").select("pet_id", fingerprint(F.col("fingerprint"), F.lit("agent"), F.col("pet_id"), F.lit("salt")).alias("fingerprint")).distinct()


def takedown(spark, sf_dir):
    photos = view(spark, sf_dir, "photos")
    rest, gone = ops.takedown(photos, photos.filter("l_partkey % 50 = 7").select("url"))
    n = rest.agg(F.count(F.lit(1)).alias("n")).select(F.lit("photos left").alias("what"), F.lit("").alias("object"), "n")
    return gone.select(F.lit("delete").alias("what"), "object", F.lit(1).cast("long").alias("n")).unionByName(n)


def source_termination(spark, sf_dir):
    return ops.terminate_source(view(spark, sf_dir, "links"), "src2")[1]


def termination_survivors(spark, sf_dir):
    """Pets that another source still lists, with the status which that gives them."""
    links = view(spark, sf_dir, "links")
    pets = view(spark, sf_dir, "listings").select("pet_id", "status")
    registry = links.select("source").distinct().withColumn("interval_s", F.lit(120 * 86400))
    return ops.survivors_of_termination(pets, links, "src2", registry, _at(LINKS_AS_OF)).select("pet_id", "status")


def _totals(spark, sf_dir) -> DataFrame:
    """Saved searches with all kinds of filters, over available pets with all facts."""
    u = F.col("user_id")
    number = lambda c, by: F.format_string("%.3f", F.col(c) + by)
    bbox = F.concat_ws(",", number("lon", -3.005), number("lat", -2.005), number("lon", 3.005), number("lat", 2.005))
    placed = lambda c: F.when(u % 9 > 1, F.col(c))
    saved = view(spark, sf_dir, "saved").select(
        u.alias("search_id"), F.when(u % 7 != 0, F.col("species")).alias("species"), F.when(u % 3 == 0, "baby,senior").when(u % 3 == 1, "adult").alias("age_group"), F.when(u % 4 == 0, "s,m").alias("size"), F.when(u % 6 == 0, "male").alias("sex"),
        F.when(u % 5 == 0, "build").when(u % 10 == 1, "HOLD").when(u % 10 == 2, "e").alias("breed"), F.when(u % 8 == 0, "kids,dogs").when(u % 8 == 3, "cats").alias("good_with"), F.when(u % 10 == 0, "low").alias("energy"), F.when(u % 9 == 4, "short,wire").alias("coat"),
        F.when(u % 11 == 0, "false").when(u % 11 == 1, "true").alias("house_trained"), (u % 2 == 0).alias("include_unknown_compat"), F.when(u % 9 == 1, bbox).alias("bbox"), placed("lat").alias("lat"), placed("lon").alias("lon"), "radius", "last_seen_total",
    )
    p = F.col("pet_id")
    one_of = lambda *x: F.element_at(F.array(*map(F.lit, x)), (p % len(x) + 1).cast("int"))
    pets = view(spark, sf_dir, "listings").filter("status = 'available'").withColumns({
        "energy_level": one_of("low", "moderate", "high", "very_high", "unknown"), "coat_length": one_of("short", "wire", "long", "unknown"), "compat_dogs": F.col("house_trained"), "compat_cats": F.when(p % 3 == 0, "true").otherwise("unknown"),
    })
    return profiles.search_totals(saved, pets)


def saved_search_totals(spark, sf_dir):
    return _totals(spark, sf_dir).select("search_id", "total")


def new_since_visit(spark, sf_dir):
    return profiles.new_since_visit(_totals(spark, sf_dir)).select("search_id", F.coalesce("new_count", F.lit(-1).cast("long")).alias("new_count"))


def _rich(spark, sf_dir) -> DataFrame:
    u = F.col("user_id")
    return view(spark, sf_dir, "saved").select(
        "user_id", F.when(u % 7 != 0, F.col("species")).alias("species"), F.when(u % 3 == 0, "baby,senior").alias("age_group"), F.when(u % 4 == 0, "s,m").alias("size"), F.when(u % 5 == 0, "Lab").alias("breed"), F.when(u % 6 == 0, "male").alias("sex"),
        F.when(u % 8 == 0, "kids,dogs").alias("good_with"), F.when(u % 10 == 0, "low").alias("energy"), F.when(u % 11 == 0, "").alias("house_trained"), (u % 2 == 0).alias("include_unknown_compat"), "radius", F.when(u % 13 == 0, "95616").alias("zip"),
        F.when(u % 4 != 0, F.col("lat")).alias("lat"), F.when(u % 4 != 0, F.col("lon")).alias("lon"),
    )


def active_filters(spark, sf_dir):
    rich = _rich(spark, sf_dir)
    return rich.select("user_id", profiles.active_filters(rich).alias("n"))


def search_key(spark, sf_dir):
    rich = _rich(spark, sf_dir)
    return rich.select("user_id", profiles.search_key(["species", "age_group", "size", "breed", "sex", "good_with", "energy", "house_trained", "radius", "zip"]).alias("search_key"))


def search_label(spark, sf_dir):
    rich = _rich(spark, sf_dir)
    return rich.select("user_id", profiles.search_label(rich).alias("label"))


def saved_searches_kept(spark, sf_dir):
    """Each user's searches, one per event, of whose kinds the newest three stay."""
    e = view(spark, sf_dir, "runs").select((F.col("run_id") % 50).alias("user_id"), F.concat(F.lit("species="), "source", F.lit("&k="), (F.col("run_id") % 7).cast("string")).alias("params"), F.col("finished_at").alias("created_at"), F.col("run_id").cast("string").alias("label"))
    return profiles.keep_searches(e, 3).select("user_id", "params", "label", "rank")


def favourites_state(spark, sf_dir):
    return profiles.favourite_states(view(spark, sf_dir, "favourites"), view(spark, sf_dir, "listings")).select("user_id", "pet_id", "state", "rank")


def _profiles(spark, sf_dir) -> DataFrame:
    pets = F.when(F.col("segment") == "BUILDING", "dogs").when(F.col("segment") == "MACHINERY", "cats").when(F.col("segment") == "HOUSEHOLD", "both").otherwise("none")
    u = F.col("user_id")
    activity = F.element_at(F.array(*map(F.lit, ("couch", "walks", "runs", "adventures"))), (u % 4 + 1).cast("int"))
    return view(spark, sf_dir, "profiles").select("user_id", "home", "kids", pets.alias("pets"), activity.alias("activity"), F.when(u % 2 == 0, "over9").otherwise("under2").alias("hours"), F.when(u % 3 == 0, "first_timer").alias("experience"))


def profile_filters(spark, sf_dir):
    return profiles.profile_filters(_profiles(spark, sf_dir)).select("user_id", "good_with", "size", "energy")


def fit_notes(spark, sf_dir):
    """Notes for each profile and the pets of its own orders."""
    p = F.col("pet_id")
    energy = F.element_at(F.array(*map(F.lit, ("low", "moderate", "high", "very_high", "unknown"))), (p % 5 + 1).cast("int"))
    pets = view(spark, sf_dir, "listings").select("pet_id", F.col("size").alias("pet_size"), "compat_kids", F.col("house_trained").alias("compat_dogs"), F.when(p % 3 == 0, "true").otherwise("unknown").alias("compat_cats"), energy.alias("energy_level"), (p % 7 == 0).alias("special_needs"), F.col("cust_id").alias("user_id"))
    pairs = pets.join(_profiles(spark, sf_dir), "user_id")
    notes = profiles.fit_notes(pairs)
    return pairs.select("user_id", "pet_id", F.array_join(F.transform(notes, lambda n: F.concat(n["tone"], F.lit(": "), n["text"])), "; ").alias("notes"))


_SB = with_views("state", "batch")
_CLASS = """c AS (SELECT coalesce(b.external_id, s.external_id) AS external_id, coalesce(b.source, s.source) AS source, coalesce(b.site, s.site) AS site, s.status AS old_status, b.status AS new_status, b.fee AS new_fee, s.fee AS old_fee, s.last_seen_at, s.first_seen_at, s.removed_at, s.version,
  CASE WHEN s.external_id IS NULL THEN 'new' WHEN b.external_id IS NULL THEN 'unseen' WHEN s.fee <> b.fee OR s.label <> b.label THEN 'changed' WHEN s.status = 'removed' THEN 'reappeared' ELSE 'unchanged' END AS kind
  FROM state s FULL JOIN batch b ON s.external_id = b.external_id AND s.source = b.source AND s.site IS NOT DISTINCT FROM b.site)"""
_GONE = "(kind = 'unseen' AND old_status <> 'removed' AND source <> 'src5')"
_RUNS = with_views("runs")
_LAST = "ok_runs AS (SELECT * FROM runs WHERE ok), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY finished_at DESC, run_id DESC) AS k FROM ok_runs) WHERE k = 1)"
_DARK = "dark AS (SELECT s.source, l.finished_at FROM (SELECT DISTINCT source FROM runs) s LEFT JOIN last l ON l.source = s.source WHERE l.finished_at IS NULL OR l.finished_at < TIMESTAMP '{at}' - INTERVAL 12 HOUR)"
_JAN = _DARK.format(at="2024-01-31 00:00:00")
_DROP = "drops AS (SELECT l.source, 'count_drop' AS kind, l.fetched, m.median FROM last l JOIN (SELECT source, quantile_cont(fetched, 0.5) AS median FROM ok_runs WHERE finished_at > TIMESTAMP '2024-01-24 00:00:00' AND finished_at <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1) m ON m.source = l.source WHERE m.median > 0 AND l.fetched < 0.6 * m.median AND l.source NOT IN (SELECT source FROM dark))"
_BAD = "bad AS (SELECT source, 'validation_failures' AS kind, round(quarantined / (fetched + quarantined), 3) AS rate FROM last WHERE fetched + quarantined > 0 AND quarantined / (fetched + quarantined) > 0.1 AND source NOT IN (SELECT source FROM dark))"
_TOTALS = f"""{with_views('saved', 'listings')}, a AS (SELECT user_id AS search_id, user_id AS u, species, radius, last_seen_total, lat, lon FROM saved),
p AS (SELECT *, ['low', 'moderate', 'high', 'very_high', 'unknown'][pet_id % 5 + 1] AS energy_level, ['short', 'wire', 'long', 'unknown'][pet_id % 4 + 1] AS coat_length, house_trained AS compat_dogs, CASE WHEN pet_id % 3 = 0 THEN 'true' ELSE 'unknown' END AS compat_cats FROM listings WHERE status = 'available'),
t AS (SELECT a.search_id, a.last_seen_total, count(p.pet_id) AS total FROM a LEFT JOIN p ON (u % 7 = 0 OR p.species = a.species) AND (u % 3 = 2 OR p.age_group IN ('baby', 'senior') AND u % 3 = 0 OR p.age_group = 'adult' AND u % 3 = 1) AND (u % 4 <> 0 OR p.size IN ('s', 'm')) AND (u % 6 <> 0 OR p.sex = 'male')
  AND (u % 5 <> 0 OR lower(raw_breed_text) LIKE '%build%') AND (u % 10 <> 1 OR lower(raw_breed_text) LIKE '%hold%') AND (u % 10 <> 2 OR lower(raw_breed_text) LIKE '%e%') AND (u % 10 <> 0 OR energy_level = 'low') AND (u % 9 <> 4 OR coat_length IN ('short', 'wire'))
  AND (u % 8 <> 0 OR (compat_kids = 'true' OR compat_kids = 'unknown' AND u % 2 = 0) AND (compat_dogs = 'true' OR compat_dogs = 'unknown' AND u % 2 = 0)) AND (u % 8 <> 3 OR compat_cats = 'true' OR compat_cats = 'unknown' AND u % 2 = 0)
  AND (u % 11 <> 0 OR house_trained = 'false') AND (u % 11 <> 1 OR house_trained = 'true') AND (u % 9 <> 1 OR p.lat BETWEEN a.lat - 2.005 AND a.lat + 2.005 AND p.lon BETWEEN a.lon - 3.005 AND a.lon + 3.005)
  AND (u % 9 <= 1 OR {_MILES.format(lat='p.lat', lon='p.lon', a='a.lat', b='a.lon')} <= a.radius) GROUP BY ALL)"""
_RICH = f"""{with_views('saved')}, r AS (SELECT user_id, CASE WHEN user_id % 7 <> 0 THEN species END AS species, CASE WHEN user_id % 3 = 0 THEN 'baby,senior' END AS age_group, CASE WHEN user_id % 4 = 0 THEN 's,m' END AS size, CASE WHEN user_id % 5 = 0 THEN 'Lab' END AS breed,
  CASE WHEN user_id % 6 = 0 THEN 'male' END AS sex, CASE WHEN user_id % 8 = 0 THEN 'kids,dogs' END AS good_with, CASE WHEN user_id % 10 = 0 THEN 'low' END AS energy, radius, CASE WHEN user_id % 13 = 0 THEN '95616' END AS zip, lat, lon FROM saved)"""
_PROF = f"""{with_views('profiles', 'listings')}, q AS (SELECT user_id, home, kids, CASE segment WHEN 'BUILDING' THEN 'dogs' WHEN 'MACHINERY' THEN 'cats' WHEN 'HOUSEHOLD' THEN 'both' ELSE 'none' END AS pets, ['couch', 'walks', 'runs', 'adventures'][user_id % 4 + 1] AS activity FROM profiles)"""
_ABOUT = lambda cond, col, good, ask, check: f"CASE WHEN {cond} THEN CASE {col} WHEN 'true' THEN 'good: Good fit: {good}' WHEN 'unknown' THEN 'check: Ask the shelter: {ask}' ELSE 'check: Check with the shelter: {check}' END END"

QUERIES = {
    sync_classify: f"{_SB}, {_CLASS} SELECT external_id, kind FROM c",
    sync_next_listings: f"""{_SB}, {_CLASS} SELECT source, site, external_id, round(coalesce(new_fee, old_fee), 2) AS fee, CASE WHEN kind <> 'unseen' THEN new_status WHEN {_GONE} THEN 'removed' ELSE old_status END AS status,
  CASE WHEN kind <> 'unseen' THEN TIMESTAMP '{RUN_AT}' ELSE last_seen_at END AS last_seen_at, CASE WHEN kind = 'new' THEN TIMESTAMP '{RUN_AT}' ELSE first_seen_at END AS first_seen_at,
  CASE WHEN {_GONE} THEN TIMESTAMP '{RUN_AT}' WHEN kind = 'unseen' THEN removed_at END AS removed_at, CASE WHEN kind IN ('new', 'changed') THEN 1 ELSE version END AS version FROM c""",
    sync_reproject: f"""{with_views('state', 'batch', 'listings')}, {_CLASS}, n AS (SELECT external_id // 2 AS pet_id, kind IN ('new', 'changed', 'reappeared') OR {_GONE} AS touched,
  CASE WHEN kind <> 'unseen' THEN new_status WHEN {_GONE} THEN 'removed' ELSE old_status END = 'available' AND CASE WHEN kind <> 'unseen' THEN TIMESTAMP '{RUN_AT}' ELSE last_seen_at END > TIMESTAMP '{RUN_AT}' - INTERVAL 3 DAY AS listed FROM c),
t AS (SELECT pet_id, bool_or(touched) AS touched, bool_or(listed) AS listed FROM n GROUP BY pet_id), p AS (SELECT DISTINCT pet_id // 2 AS pet_id FROM listings)
SELECT p.pet_id, CASE WHEN touched THEN CASE WHEN listed THEN 'available' ELSE 'removed' END WHEN p.pet_id % 5 = 0 THEN 'pending' ELSE 'available' END AS status FROM p LEFT JOIN t USING (pet_id)""",
    org_upsert: f"""{with_views('listings', 'orgs')}, l AS (SELECT pet_id, org_id, 'src' || org_id % 6 AS source, CASE WHEN pet_id % 4 = 0 THEN 'Org ' || org_id END AS name, city, lat, lon FROM listings),
k AS (SELECT l.*, g.org_id AS known, coalesce(CAST(g.org_id AS VARCHAR), sha1(l.source || '|' || l.org_id)) AS organization_id FROM l LEFT JOIN orgs g ON g.org_id = l.org_id AND g.source = l.source AND g.org_id % 3 <> 0),
w AS (SELECT organization_id, coalesce(name, 'Unknown organization') AS new_name, city AS new_city, round(lat, 6) AS new_lat FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY name NULLS LAST, city NULLS LAST, lat NULLS LAST, lon NULLS LAST) AS r FROM k WHERE known IS NULL) WHERE r = 1)
SELECT k.pet_id, organization_id, new_name, new_city, new_lat FROM k LEFT JOIN w USING (organization_id)""",
    sync_suppress_unseen: f"{_SB}, {_CLASS} SELECT source, external_id, CASE WHEN {_GONE} THEN TIMESTAMP '{RUN_AT}' ELSE removed_at END AS removed_at FROM c WHERE kind = 'unseen' AND ({_GONE} OR removed_at IS NOT NULL)",
    sync_changed_keys: f"{_SB}, {_CLASS} SELECT source, site, external_id, CASE WHEN {_GONE} THEN 'removed' ELSE kind END AS change FROM c WHERE kind IN ('new', 'changed', 'reappeared') OR {_GONE}",
    sync_run_metrics: f"""{with_views('state', 'batch', 'runs')}, {_CLASS}, q AS (SELECT 'src' || run_id % 6 AS source, sum(quarantined) AS n FROM runs GROUP BY 1)
SELECT c.source, count(*) FILTER (kind <> 'unseen') AS fetched, CAST(0 AS BIGINT) AS duplicates, count(*) FILTER (kind IN ('new', 'changed', 'reappeared')) AS changed, count(*) FILTER {_GONE} AS removed, count(DISTINCT external_id // 40) FILTER {_GONE} AS removed_pets, CAST(coalesce(any_value(q.n), 0) AS BIGINT) AS quarantined, c.source <> 'src5' AS ok
FROM c LEFT JOIN q ON q.source = c.source GROUP BY c.source""".replace("source <> 'src5') AS removed", "c.source <> 'src5') AS removed"),
    staleness_pets: f"""{with_views('state')}, s AS (SELECT external_id // 2 AS pet_id, source, site, last_seen_at, CASE WHEN source = 'src3' AND last_seen_at < DATE '1996-01-01' - INTERVAL 900 DAY THEN 'removed' ELSE status END AS status, source = 'src3' AND last_seen_at < DATE '1996-01-01' - INTERVAL 900 DAY AND status <> 'removed' AS swept FROM state),
f AS (SELECT *, CASE source WHEN 'src3' THEN CASE site WHEN 'a0' THEN 1 WHEN 'a1' THEN 200 END WHEN 'src0' THEN 300 END AS days FROM s WHERE pet_id IN (SELECT pet_id FROM s WHERE swept)),
g AS (SELECT *, last_seen_at > DATE '1996-01-01' - CASE WHEN days IS NULL THEN INTERVAL 3 DAY ELSE INTERVAL 3 DAY * days END AS fresh FROM f),
t AS (SELECT pet_id, CASE WHEN bool_or(fresh AND status = 'available') THEN 'available' ELSE 'removed' END AS status FROM g GROUP BY pet_id)
SELECT p.pet_id, coalesce(t.status, 'listed') AS status FROM (SELECT DISTINCT pet_id FROM s) p LEFT JOIN t USING (pet_id)""",
    sync_project_pets: f"""{with_views('state', 'batch', 'listings')}, {_CLASS}, k AS (SELECT * FROM c WHERE kind IN ('new', 'changed', 'reappeared') OR {_GONE}),
l AS (SELECT k.external_id, s.external_id IS NOT NULL AS linked, CASE WHEN k.external_id % 2 = 0 THEN p.lat + 1 END AS lat, CASE WHEN k.external_id % 2 = 0 THEN p.lon + 1 END AS lon
  FROM k JOIN listings p ON p.pet_id = k.external_id LEFT JOIN state s ON s.external_id = k.external_id AND s.external_id % 3 = 0)
SELECT l.external_id, CASE WHEN linked THEN CAST(l.external_id + 1 AS VARCHAR) ELSE 'new' END AS pet, round(coalesce(l.lat, o.lat), 6) AS lat, round(coalesce(l.lon, o.lon), 6) AS lon, CASE WHEN NOT linked THEN 'exact_external_id' END AS match_method
FROM l LEFT JOIN listings o ON linked AND o.pet_id = l.external_id + 1""",
    sync_photo_replace: f"""{with_views('photos')}, old AS (SELECT pet_id, pet_id || '-' || sort_order % 2 AS listing_id, url, CASE WHEN l_partkey % 2 = 0 THEN md5(url) ELSE '' END AS phash, is_primary, sort_order FROM photos),
nw AS (SELECT pet_id, pet_id || '-0' AS listing_id, unnest(list_prepend('https://img.example/new-' || pet_id, list_sort(list(DISTINCT url)))[1:3]) AS url FROM photos WHERE pet_id % 4 = 0 AND sort_order % 2 = 0 GROUP BY pet_id),
f AS (SELECT listing_id, url, row_number() OVER (PARTITION BY listing_id ORDER BY url NOT LIKE '%/new-%', url) - 1 AS k FROM nw WHERE url NOT IN (SELECT url FROM photos WHERE l_partkey % 10 = 3))
SELECT listing_id, url, phash, is_primary, CAST(sort_order AS INTEGER) AS sort_order FROM old WHERE listing_id NOT IN (SELECT listing_id FROM nw)
UNION ALL SELECT f.listing_id, f.url, coalesce((SELECT min(phash) FROM old WHERE old.listing_id = f.listing_id AND old.url = f.url AND phash <> ''), ''), k = 0, CAST(k AS INTEGER) FROM f""",
    staleness_ceiling: f"""{with_views('links')}, s AS (SELECT source, source = 'src3' AND last_seen_at < TIMESTAMP '{LINKS_AS_OF}' - INTERVAL 1500 DAY AND status <> 'removed' AS old, status FROM links)
SELECT source, CASE WHEN old THEN 'removed' ELSE status END AS status, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'src3', 'alert:staleness_ceiling', count(*) FROM s WHERE old HAVING count(*) > 0""",
    source_dark: f"{_RUNS}, {_LAST}, {_DARK.format(at='2024-02-01 00:00:00')} SELECT source, 'source_dark' AS kind, finished_at FROM dark",
    count_drop: f"{_RUNS}, {_LAST}, {_JAN}, {_DROP} SELECT * FROM drops",
    validation_failures: f"{_RUNS}, {_LAST}, {_JAN}, {_BAD} SELECT * FROM bad",
    open_alerts: f"{_RUNS}, {_LAST}, {_JAN}, {_DROP}, {_BAD}, f AS (SELECT 'source_dark' AS kind, source FROM dark UNION ALL SELECT kind, source FROM drops UNION ALL SELECT kind, source FROM bad) SELECT kind, source FROM f WHERE NOT (kind = 'count_drop' AND source < 'm')",
    report_suppression: f"""{with_views('reports')}, o AS (SELECT pet_id, fingerprint, min(created_at) AS t FROM reports WHERE NOT resolved AND (pet_id % 5 <> 0 OR created_at > TIMESTAMP '2024-01-10 00:00:00' OR pet_id NOT IN (SELECT o_orderkey FROM orders)) GROUP BY ALL)
SELECT pet_id, count(*) AS reporters, min(t) AS first_at, max(t) AS last_at FROM o GROUP BY pet_id HAVING count(*) >= 3""",
    report_removal: f"""{with_views('reports', 'listings')}, o AS (SELECT DISTINCT pet_id, fingerprint FROM reports WHERE NOT resolved AND (pet_id % 5 <> 0 OR created_at > TIMESTAMP '2024-01-10 00:00:00' OR pet_id NOT IN (SELECT o_orderkey FROM orders))),
s AS (SELECT pet_id, count(*) AS n FROM o GROUP BY pet_id HAVING count(*) >= 3)
SELECT l.pet_id, CASE WHEN s.n IS NULL THEN status ELSE 'removed' END AS status FROM listings l LEFT JOIN s USING (pet_id)
UNION ALL SELECT l.pet_id, 'user_reports ' || s.n FROM listings l JOIN s USING (pet_id) WHERE status <> 'removed' AND l.pet_id % 4 <> 0""",
    report_fingerprints: f"{with_views('reports')} SELECT DISTINCT pet_id, sha256(concat_ws('|', fingerprint, 'agent', pet_id, 'salt')) AS fingerprint FROM reports",
    takedown: f"{with_views('photos')}, g AS (SELECT DISTINCT url FROM photos WHERE l_partkey % 50 = 7) SELECT 'delete' AS what, sha1(url) || '.jpg' AS object, CAST(1 AS BIGINT) AS n FROM g UNION ALL SELECT 'photos left', '', count(*) FROM photos WHERE url NOT IN (SELECT url FROM g)",
    source_termination: f"{with_views('links')} SELECT pet_id, count(*) FILTER (source <> 'src2') AS links_left FROM links GROUP BY pet_id HAVING count(*) FILTER (source = 'src2') > 0",
    termination_survivors: f"""{with_views('links', 'listings')}, f AS (SELECT pet_id, status, last_seen_at > TIMESTAMP '{LINKS_AS_OF}' - INTERVAL 360 DAY AS fresh FROM links WHERE source <> 'src2'),
s AS (SELECT pet_id, CASE WHEN bool_or(fresh AND status = 'adopted') THEN 'adopted' WHEN bool_or(fresh AND status = 'pending') THEN 'pending' WHEN bool_or(fresh AND status = 'available') THEN 'available' ELSE 'removed' END AS status FROM f GROUP BY pet_id),
g AS (SELECT DISTINCT pet_id FROM links WHERE source = 'src2')
SELECT l.pet_id, CASE WHEN g.pet_id IS NULL THEN l.status ELSE s.status END AS status FROM listings l LEFT JOIN g USING (pet_id) LEFT JOIN s USING (pet_id) WHERE g.pet_id IS NULL OR s.pet_id IS NOT NULL""",
    saved_search_totals: f"{_TOTALS} SELECT search_id, total FROM t",
    new_since_visit: f"{_TOTALS} SELECT search_id, CASE WHEN last_seen_total IS NULL THEN -1 ELSE greatest(0, total - last_seen_total) END AS new_count FROM t",
    active_filters: f"{_RICH} SELECT user_id, CAST((breed IS NOT NULL)::INT + (size IS NOT NULL)::INT + (sex IS NOT NULL)::INT + (good_with IS NOT NULL)::INT + (user_id % 2 <> 0)::INT AS INTEGER) AS n FROM r",
    search_key: f"""{_RICH} SELECT user_id, concat_ws('&', 'age_group=' || age_group, 'breed=' || breed, 'energy=' || energy, 'good_with=' || good_with, 'radius=' || radius, 'sex=' || sex, 'size=' || size, 'species=' || species, 'zip=' || zip) AS search_key FROM r""",
    search_label: f"""{_RICH} SELECT user_id, concat_ws(' · ', CASE WHEN species IS NULL THEN 'All pets' WHEN species = 'other' THEN 'Other pets' ELSE upper(species[1]) || species[2:] || 's' END, CASE WHEN age_group IS NOT NULL THEN 'Baby/Senior' END, CASE WHEN size IS NOT NULL THEN 'size S/M' END,
  CASE WHEN energy IS NOT NULL THEN 'low energy' END, CASE WHEN good_with IS NOT NULL THEN 'good with kids & dogs' END, CASE WHEN zip IS NOT NULL THEN 'within ' || radius || ' mi of ' || zip WHEN user_id % 4 <> 0 AND ({_BORDER_SQL}) THEN 'within ' || CASE radius WHEN 10 THEN 15 WHEN 25 THEN 40 WHEN 50 THEN 80 ELSE 160 END || ' km of you' WHEN user_id % 4 <> 0 THEN 'within ' || radius || ' mi of you' END) AS label FROM r""",
    saved_searches_kept: f"""{_RUNS}, e AS (SELECT run_id % 50 AS user_id, 'species=' || source || '&k=' || run_id % 7 AS params, finished_at AS created_at, CAST(run_id AS VARCHAR) AS label FROM runs),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, params ORDER BY created_at, label) AS k FROM e) WHERE k = 1),
g AS (SELECT user_id, params, label, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, params) AS INTEGER) AS rank FROM f) SELECT * FROM g WHERE rank <= 3""",
    favourites_state: f"""{with_views('favourites', 'listings')}, o AS (SELECT user_id, pet_id, max(added_at) AS added_at FROM favourites GROUP BY ALL)
SELECT o.user_id, o.pet_id, CASE WHEN status IS NULL THEN 'not listed' WHEN status IN ('adopted', 'removed') THEN 'found a home' ELSE 'active' END AS state, CAST(row_number() OVER (PARTITION BY o.user_id ORDER BY added_at DESC, o.pet_id DESC) AS INTEGER) AS rank FROM o LEFT JOIN listings l ON l.pet_id = o.pet_id""",
    profile_filters: f"""{_PROF} SELECT user_id, nullif(concat_ws(',', CASE WHEN kids IN ('little', 'big') THEN 'kids' END, CASE WHEN pets IN ('dogs', 'both') THEN 'dogs' END, CASE WHEN pets IN ('cats', 'both') THEN 'cats' END), '') AS good_with, CASE WHEN home = 'apartment' THEN 'xs,s,m' END AS size,
  CASE activity WHEN 'couch' THEN 'low,moderate' WHEN 'runs' THEN 'moderate,high,very_high' WHEN 'adventures' THEN 'moderate,high,very_high' END AS energy FROM q""",
    fit_notes: f"""{_PROF}, p AS (SELECT pet_id, size, compat_kids, house_trained AS compat_dogs, CASE WHEN pet_id % 3 = 0 THEN 'true' ELSE 'unknown' END AS compat_cats, ['low', 'moderate', 'high', 'very_high', 'unknown'][pet_id % 5 + 1] AS energy, pet_id % 7 = 0 AS special, cust_id AS user_id FROM listings),
n AS (SELECT q.user_id, pet_id, list_filter([
  CASE WHEN home = 'apartment' AND size IN ('xs', 's', 'm') AND energy IN ('low', 'moderate') THEN 'good: Good fit: apartment living' WHEN home = 'apartment' AND (size = 'xl' OR energy = 'very_high') THEN 'check: Check with the shelter: space & energy needs' END,
  {_ABOUT("kids IN ('little', 'big')", 'compat_kids', 'kids at home', 'kids at home', 'kids')}, {_ABOUT("pets IN ('dogs', 'both')", 'compat_dogs', 'your dog', 'dog compatibility', 'dogs at home')}, {_ABOUT("pets IN ('cats', 'both')", 'compat_cats', 'your cat', 'cat compatibility', 'cats at home')},
  CASE WHEN q.user_id % 2 = 0 AND energy IN ('high', 'very_high') THEN 'check: Check with the shelter: long days alone' END, CASE WHEN q.user_id % 2 <> 0 THEN 'good: Good fit: someone''s usually home' END,
  CASE WHEN activity = 'adventures' AND energy IN ('high', 'very_high') THEN 'good: Good fit: adventure buddy' END, CASE WHEN q.user_id % 3 = 0 AND special THEN 'check: Check with the shelter: special-care needs' END], lambda x: x IS NOT NULL)[1:4] AS notes
  FROM p JOIN q ON q.user_id = p.user_id)
SELECT user_id, pet_id, array_to_string(notes, '; ') AS notes FROM n""",
}
