"""Registered queries of search, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import joined
from ..model import BORDER
from ..operators import filters, profiles, search
from ..sources import places
from ..staging import shared_dir
from ..operators.search import SearchFilter
from .views import view, with_views

PLACE = (34.0, -99.0)
_MILES = "2 * 3958.8 * asin(least(1.0, sqrt(pow(sin(radians({lat} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({lat})) * pow(sin(radians({lon} - ({b})) / 2), 2))))"
MILES = _MILES.format(lat="lat", lon="lon", a="34.0", b="-99.0")
FIRST = """first_photo AS (SELECT pet_id, url AS photo_url, blur AS photo_blur FROM (SELECT *, row_number() OVER (PARTITION BY pet_id ORDER BY is_primary DESC, sort_order, photo_id) AS k FROM photos) WHERE k = 1)"""
AGE_LABEL = "CASE age_group WHEN 'baby' THEN 'Baby' WHEN 'young' THEN 'Young' WHEN 'adult' THEN 'Adult' WHEN 'senior' THEN 'Senior' ELSE 'Age unknown' END"
BREED_LABEL = "CASE WHEN raw_breed_text <> '' THEN raw_breed_text WHEN is_mixed THEN 'Mixed breed' ELSE 'Breed unknown' END"
DOG = SearchFilter(species="dog", size=["s", "m", "l"], good_with=["kids"], lat=PLACE[0], lon=PLACE[1], radius=1000)
DOG_SQL = f"species = 'dog' AND size IN ('s', 'm', 'l') AND compat_kids IN ('true', 'unknown') AND status = 'available' AND {MILES} <= 1000"
CARD_SQL = f"""SELECT l.pet_id, name, species, age_group, {AGE_LABEL} AS age_label, {BREED_LABEL} AS breed_label, floor(({_MILES.format(lat="l.lat", lon="l.lon", a="34.0", b="-99.0")}) * 10 + 0.5) / 10 AS distance_mi,
  city, o.state, o.org_name, o.source AS source_label, status, updated_at AS listed_at, photo_url, photo_blur, name || ', a ' || lower({AGE_LABEL}) || ' ' || {BREED_LABEL} AS photo_alt, l.lat, l.lon
FROM picked l JOIN orgs o ON o.org_id = l.org_id LEFT JOIN first_photo p ON p.pet_id = l.pet_id"""
BASIC = ("pet_id", "species", "age_group", "size", "house_trained", "compat_kids", "status")


def _listings(spark: SparkSession, sf_dir: str, want: SearchFilter | None = None) -> DataFrame:
    pets = view(spark, sf_dir, "listings")
    return pets.filter(want.predicate()) if want else pets


def search_freshness_page(spark, sf_dir):
    picked = search.page(_listings(spark, sf_dir, DOG), limit=24).limit(24)
    return search.cards(picked, view(spark, sf_dir, "orgs"), view(spark, sf_dir, "photos"), PLACE)


def search_distance_page(spark, sf_dir):
    pets = _listings(spark, sf_dir, SearchFilter(lat=PLACE[0], lon=PLACE[1], radius=100))
    return search.page(pets, "distance", PLACE).limit(24).select("pet_id", "species", geo.half_up(search.miles_from(*PLACE), 1).alias("distance_mi"))


def search_keyset_page2(spark, sf_dir):
    out = []
    for sort in ("freshness", "distance"):
        pets = _listings(spark, sf_dir, SearchFilter(species="cat", lat=PLACE[0], lon=PLACE[1], radius=1000))
        after = search.cursor(search.page(pets, sort, PLACE), sort, PLACE)
        rows = search.page(pets, sort, PLACE, after).limit(24) if after else pets.limit(0)
        out.append(rows.select(F.lit(sort).alias("sort"), "pet_id"))
    return out[0].unionByName(out[1])


def search_offset_page(spark, sf_dir):
    return search.offset_page(_listings(spark, sf_dir, SearchFilter(statuses=("available", "pending"))), 48).select("pet_id", "updated_at", "status")


def search_bbox(spark, sf_dir):
    return _listings(spark, sf_dir, SearchFilter(bbox=(-105.0, 30.0, -95.0, 36.0))).select("pet_id", "lat", "lon")


def search_breed_contains(spark, sf_dir):
    return _listings(spark, sf_dir, SearchFilter(breed="Build", sex="female", age_group=["baby", "senior"])).select("pet_id", "raw_breed_text", "sex", "age_group")


def search_tristate(spark, sf_dir):
    both = [_listings(spark, sf_dir, SearchFilter(good_with=["kids"], include_unknown_compat=u)).select(F.lit(u).alias("unknown_too"), *BASIC) for u in (True, False)]
    return both[0].unionByName(both[1])


def search_house_trained(spark, sf_dir):
    return _listings(spark, sf_dir, SearchFilter(house_trained=True)).select(*BASIC)


def search_facets(spark, sf_dir):
    return search.facets(_listings(spark, sf_dir, SearchFilter(size=["s", "m", "l"])))


def search_zip_origin(spark, sf_dir):
    """Each saved search with a zip of its own (some unknown), and its available pets within the radius."""
    saved = view(spark, sf_dir, "saved").select("user_id", "species", "radius", F.lpad((F.col("user_id") % 30 + 10000).cast("string"), 5, "0").alias("zip"))
    asked = search.zip_origin(saved, view(spark, sf_dir, "zips"))
    pets = _listings(spark, sf_dir, SearchFilter()).select("pet_id", "species", "lat", "lon")
    searches = asked.select(F.col("user_id").alias("search_id"), "species", "radius", F.col("origin_lat").alias("lat"), F.col("origin_lon").alias("lon"), "zip", "origin_resolved", F.lit(None).cast("long").alias("last_seen_total"))
    return profiles.search_totals(searches, pets).select(F.col("search_id").alias("user_id"), "zip", "origin_resolved", F.col("total").alias("n"))


def featured_topk(spark, sf_dir):
    return search.page(_listings(spark, sf_dir, SearchFilter()), limit=8).limit(8).select("pet_id", "name", "updated_at")


def hero_stats(spark, sf_dir):
    return search.hero_stats(_listings(spark, sf_dir, SearchFilter()), view(spark, sf_dir, "photos"))


def pet_detail_nested(spark, sf_dir):
    out = search.pet_details(_listings(spark, sf_dir), *(view(spark, sf_dir, n) for n in ("orgs", "photos", "links")))
    return out.select("pet_id", "org_name", F.array_join("photos.url", ",").alias("photo_urls"), F.coalesce(F.size("links"), F.lit(0)).alias("n_links"), F.array_join("links.source", ",").alias("sources"))


def _saved_raw(saved: DataFrame) -> DataFrame:
    u = F.col("user_id")
    text = lambda c: F.col(c).cast("string")
    return saved.select(
        "user_id", "species", F.when(u % 7 == 0, "30").otherwise(text("radius")).alias("radius"), F.when(u % 11 == 0, "95").otherwise(text("lat")).alias("lat"),
        F.when(u % 5 != 1, text("lon")).alias("lon"), F.when(u % 13 == 0, "123").alias("zip"), F.when(u % 3 == 0, "distance").alias("sort"), F.when(u % 17 == 0, "0").alias("limit"),
        F.when(u % 19 == 0, "baby,elder").alias("age_group"),
    )


def filter_validation(spark, sf_dir):
    out = filters.validate_filters(_saved_raw(view(spark, sf_dir, "saved")))
    return out.select("user_id", "valid", F.array_join("faults", ",").alias("faults"), "species", "radius", "sort", "limit", "zip", "include_unknown_compat")


def data_bounds(spark, sf_dir):
    return search.data_bounds(_listings(spark, sf_dir))


def geo_cell_clusters(spark, sf_dir):
    out = search.geo_clusters(_listings(spark, sf_dir, SearchFilter()), 6)
    return out.select("cell_x", "cell_y", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "circle")


def search_places_table(spark, sf_dir):
    """A radius search in a table of places that is written in Z-order."""
    at = f"{shared_dir(spark)}/places-{uuid.uuid4().hex}"
    places.write_places(view(spark, sf_dir, "listings").select("pet_id", "status", "lat", "lon"), at)
    return places.near(spark, at, *PLACE, 250.0).select("pet_id", "status")


def geo_pyramid(spark, sf_dir):
    """Clusters at all zoom levels."""
    out = search.geo_pyramid(_listings(spark, sf_dir, SearchFilter()))
    return out.select("zoom", "cell_x", "cell_y", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "circle")


def map_features(spark, sf_dir):
    return search.map_features(_listings(spark, sf_dir, SearchFilter()))


def coarse_origins(spark, sf_dir):
    """A visitor at a third of each organisation's coordinates, and the map around."""
    lat, lon = F.col("lat") / 3, F.col("lon") / 3
    near = geo.coarse_place(lat, lon)
    return view(spark, sf_dir, "orgs").select("org_id", near[0].alias("lat"), near[1].alias("lon"), geo.viewport(lon - 1, lat - 1, lon + 1, lat + 1).alias("viewport"))


def distance_labels(spark, sf_dir):
    orgs = view(spark, sf_dir, "orgs")
    miles = geo.half_up(search.miles_from(*PLACE), 1)
    metric = F.col("org_id") % 2 == 0
    radius = F.element_at(F.array(*(F.lit(float(r)) for r in (10, 25, 50, 100))), (F.col("org_id") % 4 + 1).cast("int"))
    return orgs.select("org_id", geo.distance_text(miles, metric).alias("distance"), geo.radius_text(radius, metric).alias("radius"), (miles <= 5).alias("near"))


def border_test(spark, sf_dir):
    c = view(spark, sf_dir, "listings").select("pet_id", (F.col("lat") + 18.0).alias("lat"), (F.col("lon") + 30.0 + F.col("pet_id") % 7).alias("lon")).filter("lat IS NOT NULL")
    return c.select("pet_id", geo.north_of_border(F.col("lat"), F.col("lon")).alias("north"))


def facts_line(spark, sf_dir):
    pets = view(spark, sf_dir, "listings").join(view(spark, sf_dir, "orgs").select("org_id", "org_name", F.col("state").alias("org_state")), "org_id")
    breed = search.breed_label(F.col("raw_breed_text"), F.col("is_mixed"))
    known = lambda c: F.when(F.col(c) != "unknown", F.col(c))
    listed = geo.elapsed_text(F.col("updated_at").cast("timestamp"), F.lit("1998-08-03 12:00:00").cast("timestamp"))
    return pets.select("pet_id", joined(" · ", search.age_label(F.col("age_group")), breed, known("sex"), known("size")).alias("facts"), joined(", ", F.col("org_name"), F.col("org_state")).alias("place"), listed.alias("listed"))


_BORDER_SQL = "CASE WHEN lon < -141 OR lon > -52.6 OR lat > 84 THEN FALSE " + " ".join(
    f"WHEN lon >= {x1:.2f}::DOUBLE AND lon <= {x2:.2f}::DOUBLE THEN lat > {y1:.2f}::DOUBLE + (lon - ({x1:.2f}::DOUBLE)) / ({x2:.2f}::DOUBLE - ({x1:.2f}::DOUBLE)) * ({y2:.2f}::DOUBLE - {y1:.2f}::DOUBLE)" for (x1, y1), (x2, y2) in zip(BORDER, BORDER[1:])
) + " ELSE FALSE END"
_WORLD = "(512 * 64 / 50.0::DOUBLE)"
L, LO, LP = with_views("listings"), with_views("listings", "orgs"), with_views("listings", "photos")

QUERIES = {
    search_freshness_page: f"{with_views('listings', 'orgs', 'photos')}, {FIRST}, picked AS (SELECT * FROM listings WHERE {DOG_SQL} ORDER BY updated_at DESC, pet_id DESC LIMIT 24) {CARD_SQL}",
    search_distance_page: f"{L} SELECT pet_id, species, floor(({MILES}) * 10 + 0.5) / 10 AS distance_mi FROM listings WHERE status = 'available' AND {MILES} <= 100 ORDER BY {MILES}, pet_id LIMIT 24",
    search_keyset_page2: f"""{L}, c AS (SELECT pet_id, row_number() OVER (ORDER BY updated_at DESC, pet_id DESC) AS f, row_number() OVER (ORDER BY {MILES}, pet_id) AS d FROM listings WHERE species = 'cat' AND status = 'available' AND {MILES} <= 1000)
SELECT 'freshness' AS sort, pet_id FROM c WHERE f BETWEEN 25 AND 48 UNION ALL SELECT 'distance', pet_id FROM c WHERE d BETWEEN 25 AND 48""",
    search_offset_page: f"{L} SELECT pet_id, updated_at, status FROM listings WHERE status IN ('available', 'pending') ORDER BY updated_at DESC, pet_id DESC LIMIT 24 OFFSET 48",
    search_bbox: f"{L} SELECT pet_id, lat, lon FROM listings WHERE status = 'available' AND lat BETWEEN 30 AND 36 AND lon BETWEEN -105 AND -95",
    search_breed_contains: f"{L} SELECT pet_id, raw_breed_text, sex, age_group FROM listings WHERE status = 'available' AND contains(lower(raw_breed_text), 'build') AND sex = 'female' AND age_group IN ('baby', 'senior')",
    search_tristate: f"{L} SELECT unknown_too, {', '.join(BASIC)} FROM listings, (VALUES (TRUE), (FALSE)) v(unknown_too) WHERE status = 'available' AND (compat_kids = 'true' OR unknown_too AND compat_kids = 'unknown')",
    search_house_trained: f"{L} SELECT {', '.join(BASIC)} FROM listings WHERE status = 'available' AND house_trained = 'true'",
    search_facets: f"""{L}, c AS (SELECT * FROM listings WHERE status = 'available' AND size IN ('s', 'm', 'l'))
SELECT 'species' AS facet, species AS value, count(*) AS n FROM c GROUP BY species UNION ALL SELECT 'age_group', age_group, count(*) FROM c GROUP BY age_group UNION ALL SELECT 'total', 'all', count(*) FROM c""",
    search_zip_origin: f"""{with_views('saved', 'zips', 'listings')}, a AS (SELECT s.user_id, s.species, s.radius, lpad(CAST(s.user_id % 30 + 10000 AS VARCHAR), 5, '0') AS zip FROM saved s),
b AS (SELECT a.*, z.lat AS zlat, z.lon AS zlon FROM a LEFT JOIN zips z ON z.zip = a.zip),
p AS (SELECT * FROM listings WHERE status = 'available')
SELECT b.user_id, b.zip, b.zlat IS NOT NULL AS origin_resolved, count(p.pet_id) AS n FROM b
LEFT JOIN p ON p.species = b.species AND (b.zlat IS NULL OR {_MILES.format(lat='p.lat', lon='p.lon', a='b.zlat', b='b.zlon')} <= b.radius) GROUP BY ALL""",
    featured_topk: f"{L} SELECT pet_id, name, updated_at FROM listings WHERE status = 'available' ORDER BY updated_at DESC, pet_id DESC LIMIT 8",
    hero_stats: f"""{LP}, {FIRST}, a AS (SELECT * FROM listings WHERE status = 'available'), r AS (SELECT * FROM a ORDER BY updated_at DESC, pet_id DESC LIMIT 48),
k AS (SELECT r.pet_id, photo_url, row_number() OVER (ORDER BY photo_url IS NULL, updated_at DESC, r.pet_id DESC) AS face_rank FROM r LEFT JOIN first_photo p ON p.pet_id = r.pet_id)
SELECT (SELECT count(*) FROM a) AS total, CAST(face_rank AS INTEGER) AS face_rank, pet_id, photo_url FROM k WHERE face_rank <= 4""",
    pet_detail_nested: f"""{with_views('listings', 'orgs', 'photos', 'links')}, p AS (SELECT pet_id, string_agg(url, ',' ORDER BY is_primary DESC, sort_order, photo_id) AS photo_urls FROM photos GROUP BY pet_id),
k AS (SELECT pet_id, CAST(count(*) AS INTEGER) AS n_links, string_agg(source, ',' ORDER BY link_id, source, status) AS sources FROM links GROUP BY pet_id)
SELECT l.pet_id, o.org_name, photo_urls, coalesce(n_links, 0) AS n_links, sources FROM listings l JOIN orgs o ON o.org_id = l.org_id LEFT JOIN p ON p.pet_id = l.pet_id LEFT JOIN k ON k.pet_id = l.pet_id""",
    filter_validation: f"""{with_views('saved')}, f AS (SELECT user_id, species, radius, user_id % 7 = 0 AS r, user_id % 11 = 0 AS la, user_id % 13 = 0 AS z, user_id % 17 = 0 AS li, user_id % 19 = 0 AS ag,
  user_id % 3 = 0 AND user_id % 13 <> 0 AND user_id % 5 = 1 AS np FROM saved),
g AS (SELECT *, array_to_string(list_filter([CASE WHEN ag THEN 'age_group' END, CASE WHEN z THEN 'zip' END, CASE WHEN la THEN 'lat' END, CASE WHEN r THEN 'radius' END, CASE WHEN li THEN 'limit' END, CASE WHEN np THEN 'sort without place' END], lambda x: x IS NOT NULL), ',') AS faults FROM f)
SELECT user_id, faults = '' AS valid, faults, CASE WHEN faults = '' THEN species END AS species, CASE WHEN faults = '' THEN CAST(radius AS VARCHAR) ELSE '50' END AS radius,
  CASE WHEN faults = '' AND user_id % 3 = 0 THEN 'distance' ELSE 'freshness' END AS sort, '24' AS limit, CAST(NULL AS VARCHAR) AS zip, 'true' AS include_unknown_compat FROM g""",
    data_bounds: f"{L} SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM listings WHERE lat IS NOT NULL",
    geo_cell_clusters: f"""{L}, c AS (SELECT CAST(floor((lon + 180) / 360 * {_WORLD}) AS BIGINT) AS cell_x, CAST(floor((0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) * {_WORLD}) AS BIGINT) AS cell_y, lat, lon FROM listings WHERE status = 'available' AND lat IS NOT NULL)
SELECT cell_x, cell_y, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, CASE WHEN count(*) < 5 THEN 14 WHEN count(*) < 15 THEN 18 WHEN count(*) < 50 THEN 24 ELSE 30 END AS circle FROM c GROUP BY ALL""",
    search_places_table: f"{L} SELECT pet_id, status FROM listings WHERE {MILES} <= 250",
    geo_pyramid: f"""{L}, c AS (SELECT CAST(z AS INTEGER) AS zoom, CAST(floor((lon + 180) / 360 * (512 * pow(2, z) / 50)) AS BIGINT) AS cell_x, CAST(floor((0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) * (512 * pow(2, z) / 50)) AS BIGINT) AS cell_y, lat, lon FROM listings, range(17) t(z) WHERE status = 'available' AND lat IS NOT NULL)
SELECT zoom, cell_x, cell_y, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, CASE WHEN count(*) < 5 THEN 14 WHEN count(*) < 15 THEN 18 WHEN count(*) < 50 THEN 24 ELSE 30 END AS circle FROM c GROUP BY ALL""",
    map_features: f"{L} SELECT pet_id, name, lon, lat FROM listings WHERE status = 'available' AND lat IS NOT NULL",
    coarse_origins: f"""{with_views('orgs')} SELECT org_id, floor((lat / 3) * 100 + 0.5) / 100 AS lat, floor((lon / 3) * 100 + 0.5) / 100 AS lon,
  printf('%.3f,%.3f,%.3f,%.3f', lon / 3 - 1, lat / 3 - 1, lon / 3 + 1, lat / 3 + 1) AS viewport FROM orgs""",
    distance_labels: f"""{with_views('orgs')}, m AS (SELECT org_id, floor(({MILES}) * 10 + 0.5) / 10 AS mi, [10, 25, 50, 100][org_id % 4 + 1] AS r FROM orgs)
SELECT org_id, CASE WHEN org_id % 2 = 0 THEN CAST(CAST(floor(mi * 1.609344::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || ' km' WHEN mi = floor(mi) THEN CAST(CAST(mi AS BIGINT) AS VARCHAR) || ' mi' ELSE printf('%.1f', mi) || ' mi' END AS distance,
  CASE WHEN org_id % 2 = 0 THEN CAST(CAST(floor(r * 1.609344::DOUBLE / 5 + 0.5) * 5 AS BIGINT) AS VARCHAR) || ' km' ELSE CAST(r AS VARCHAR) || ' mi' END AS radius, mi <= 5 AS near FROM m""",
    border_test: f"{L}, c AS (SELECT pet_id, lat + 18.0 AS lat, lon + 30.0 + pet_id % 7 AS lon FROM listings WHERE lat IS NOT NULL) SELECT pet_id, {_BORDER_SQL} AS north FROM c",
    facts_line: f"""{LO}, h AS (SELECT l.*, o.org_name, o.state AS org_state, CAST(floor((epoch(TIMESTAMP '1998-08-03 12:00:00') - epoch(CAST(updated_at AS TIMESTAMP))) / 3600) AS BIGINT) AS hours FROM listings l JOIN orgs o ON o.org_id = l.org_id)
SELECT pet_id, concat_ws(' · ', {AGE_LABEL}, {BREED_LABEL}, nullif(sex, 'unknown'), nullif(size, 'unknown')) AS facts, concat_ws(', ', org_name, org_state) AS place,
  CASE WHEN hours < 1 THEN 'under an hour ago' WHEN hours < 24 THEN hours || 'h ago' ELSE (hours // 24) || 'd ago' END AS listed FROM h""",
}
