"""Feeds, normalization, sync, search and tables on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from fernspark.functions import geo
from fernspark.functions.hashes import bare_id, hamming, source_kind, source_site
from fernspark.operators import filters, normalize, ops, profiles, search, sync
from fernspark.operators.search import SearchFilter
from fernspark.sources import feeds, snapshot, tables


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_tags_fill_only_unknowns(spark):
    row = ("Rex ", "dog", "Lab", "", None, None, None, None, {"kids_ok": "false"}, ["Good With KIDS!", " no   dogs ", "no dogs", "Cuddly ", "constructor", "good with dogs"])
    df = spark.createDataFrame([row], "name string, species string, breed_primary string, breed_secondary string, breed_mixed boolean, age string, sex string, size string, attributes map<string,string>, tags array<string>")
    r = normalize.normalize(df).first()
    assert (r["compat_kids"], r["compat_dogs"], r["compat_cats"], r["traits"]) == ("false", "false", "unknown", ["Cuddly", "constructor"])
    assert (r["name"], r["raw_breed_text"], r["is_mixed"], r["age_group"], r["age_confidence"]) == ("Rex", "Lab", False, "unknown", "unknown")


def test_mixed_breeds(spark):
    rows = [("Lab mix", None, None), ("Lab", "Pug", None), ("Lab", None, True), (None, None, None), ("Crossbill", None, False)]
    df = spark.createDataFrame(rows, "p string, s string, m boolean")
    from fernspark.functions.text import is_mixed

    assert [r[0] for r in df.select(is_mixed(F.col("m"), F.col("p"), F.col("s"))).collect()] == [True, True, True, False, False]


def test_widget_feed(spark, tmp_path):
    animals = [{"ID": 5, "ANIMALNAME": " Zoe ", "SPECIESNAME": "Guinea Pig", "WEBSITEIMAGECOUNT": 9, "AGEGROUP": " Puppy", "ISGOODWITHCATSNAME": "No", "CROSSBREED": 1, "BREEDNAME": "a", "BREEDNAME1": "", "BREEDNAME2": "b", "WEBSITEMEDIANOTES": "", "ANIMALCOMMENTS": " hi "}, {"ANIMALNAME": "x"}]
    body = "x; adoptables = " + json.dumps(animals) + "; more];"
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"account": a, "body": b}) for a, b in (("k", body), ("q", "nothing"), ("r", "adoptables = [1"), ("s", "adoptables = [{];"))))
    registry = spark.createDataFrame([("k", "Shelter K", "C", "R", 1.0, None, False)], "account string, name string, city string, region string, lat double, lon double, suppress_descriptions boolean")
    good, bad = feeds.read_widget(spark, str(tmp_path), registry, F.lit("2024-01-01").cast("timestamp"))
    (g,) = good.collect()
    assert (g["external_id"], g["name"], g["species"], g["age"], len(g["photos"]), g["breed_primary"], g["breed_secondary"], g["description"]) == ("5", "Zoe", "small_furry", "baby", 6, "a", "b", "hi")
    assert g["lat"] is None and g["city"] is None and g["org_name"] == "Shelter K" and g["attributes"] == {"cats_ok": "false"}
    assert sorted((r["source_id"], tuple(r["reasons"])) for r in bad.collect()) == [("asm3:k", ("missing id",)), ("asm3:q", ("payload not found",)), ("asm3:r", ("payload not terminated",)), ("asm3:s", ("payload unreadable",))]


def test_page_feed_keeps_typed_attributes_only(spark, tmp_path):
    page = {"data": [
        {"id": "1", "type": "animals", "attributes": {"name": "", "isKidsOk": "true", "isDogsOk": False, "qualities": ["calm", 3, "old"], "lat": "x"}, "relationships": {"orgs": {"data": [{"id": "9", "type": "orgs"}, {"id": "8", "type": "orgs"}]}, "pictures": {"data": {"id": "p", "type": "pictures"}}}},
        {"id": "2", "type": "animals", "attributes": {}, "relationships": {}}],
        "included": [{"id": "9", "type": "orgs", "attributes": {"name": "O", "lat": 1.5, "lon": "2"}}, {"id": "p", "type": "pictures", "attributes": {"url": "http://a/1.jpg"}}, {"id": "p", "type": "pictures", "attributes": {"large": {"url": "http://a/2.jpg"}}}]}
    (tmp_path / "p.json").write_text(json.dumps({"page_id": "1", "body": json.dumps(page)}) + "\n" + json.dumps({"page_id": "2", "body": "{oops"}))
    good, bad = feeds.read_pages(spark, str(tmp_path))
    (g,) = good.collect()
    assert (g["name"], g["attributes"], g["tags"], g["photos"], g["org_external_id"], g["org_name"], g["lat"], g["lon"]) == ("Unknown", {"dogs_ok": "false"}, ["calm", "old"], ["http://a/2.jpg"], "9", "O", 1.5, None)
    assert sorted(tuple(r["reasons"]) for r in bad.collect()) == [("missing organisation",), ("payload unreadable",)]


def test_resources_are_found_in_small_buckets(spark):
    """The first of an id counts, and no look-up goes through all resources of a page."""
    n = 10_000
    page = spark.range(1).select(F.concat(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(k.cast("string").alias("id"), k.alias("attributes"))), F.array(F.struct(F.lit("7").alias("id"), F.lit(-7).alias("attributes")))).alias("r"))
    b = page.select(feeds.bucketed(F.col("r"), lambda x: x).alias("b"))
    r = b.select(*(feeds.in_buckets(F.col("b"), F.lit(k)).alias(f"k{k}") for k in ("7", "9999", "none")), feeds.in_buckets(F.col("b"), F.lit(None).cast("string")).alias("null"), F.array_max(F.transform("b", lambda x: F.size(x["ids"]))).alias("most")).first()
    assert tuple(r)[:4] == (7, 9999, None, None) and r["most"] < 300
    assert page.select(feeds.in_buckets(feeds.bucketed(F.filter("r", lambda x: x["id"] == ""), lambda x: x), F.lit("7"))).first()[0] is None


def test_pages_without_included_resources_keep_their_animals(spark, tmp_path):
    from fernspark.plans import ingest_queries

    spark.sql("SELECT id * 17 AS o_orderkey, 1L AS o_custkey, '1-URGENT' AS o_orderpriority FROM range(2)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 900L AS l_orderkey, 1L AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 1L AS s_suppkey, 'S' AS s_name, 1 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted((r["pet_id"], r["photos"], r["reasons"]) for r in ingest_queries.page_flatten_included(spark, str(tmp_path)).collect()) == [(0, "", "missing organisation"), (17, "", "missing organisation")]


def test_null_page_is_unreadable(spark):
    pages = spark.createDataFrame([("1", None), ("2", '{"data":[]}')], "page_id string, body string")
    assert [(r["name"], r["raw"], r["reasons"]) for r in feeds.page_listings(pages).collect()] == [(None, None, ["payload unreadable"])]


def test_hashes_and_ids(spark):
    r = one(spark, a=hamming(F.lit("ffffffffffffffff"), F.lit("0000000000000000")), b=hamming(F.lit("ff"), F.lit("0")), c=bare_id(F.lit("00A7")), d=bare_id(F.lit("000")), e=source_kind(F.lit("a:b:c")), f=source_site(F.lit("a:b:c")), g=source_site(F.lit("a")))
    assert tuple(r) == (64, None, "a7", None, "a", "b:c", None)


def test_geo(spark):
    r = one(
        spark, miles=geo.haversine_miles(F.lit(38.5), F.lit(-121.7), F.lit(38.5), F.lit(-121.7)), half=geo.half_up(F.lit(0.25), 1), km=geo.distance_text(F.lit(59.1), F.lit(True)), mi=geo.distance_text(F.lit(59.0), F.lit(False)),
        radius=geo.radius_text(F.lit(50.0), F.lit(True)), seattle=geo.north_of_border(F.lit(47.6), F.lit(-122.3)), vancouver=geo.north_of_border(F.lit(49.3), F.lit(-123.1)), east=geo.north_of_border(F.lit(50.0), F.lit(10.0)),
    )
    assert tuple(r) == (0.0, 0.3, "95 km", "59 mi", "80 km", False, True, False)


STATE = "source string, site string, external_id long, fee double, status string, last_seen_at timestamp"
BATCH = "source string, site string, external_id long, fee double, status string, ingest_order int"


def test_sync(spark):
    import datetime as dt

    old, at = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    state = spark.createDataFrame([("a", None, 1, 1.0, "available", old), ("a", "x", 1, 1.0, "removed", old), ("a", None, 2, 1.0, "available", old), ("b", None, 3, 1.0, "available", old), ("a", None, 5, 1.0, "removed", old)], STATE)
    batch = spark.createDataFrame([("a", None, 1, 9.0, "available", 1), ("a", None, 1, 1.0, "available", 2), ("a", "x", 1, 1.0, "pending", 1), ("a", None, 4, 1.0, "available", 1)], BATCH)
    kinds = sync.classify(state, batch)
    got = {(k["source"], k["site"], k["external_id"]): r["kind"] for r in kinds.collect() for k in [r["b"] or r["s"]]}
    assert got == {("a", None, 1): "unchanged", ("a", "x", 1): "reappeared", ("a", None, 2): "unseen", ("b", None, 3): "unseen", ("a", None, 4): "new", ("a", None, 5): "unseen"}
    after = sync.next_listings(kinds, F.lit(at), ["a"])
    status = {(r["source"], r["site"], r["external_id"]): (r["status"], r["last_seen_at"] == at) for r in after.collect()}
    assert status == {("a", None, 1): ("available", True), ("a", "x", 1): ("pending", True), ("a", None, 2): ("removed", False), ("b", None, 3): ("available", False), ("a", None, 4): ("available", True), ("a", None, 5): ("removed", False)}
    kept = {(r["source"], r["site"], r["external_id"]): (r["first_seen_at"], r["removed_at"], r["version"]) for r in after.collect()}
    assert kept["a", None, 4] == (at, None, 1) and kept["a", None, 2] == (None, at, None) and kept["a", "x", 1] == (None, None, None)
    later = dt.datetime(2024, 1, 3)
    third = sync.next_listings(sync.classify(after.drop("kind", "hash"), batch.filter("external_id = 1").withColumn("fee", F.col("fee") + 1)), F.lit(later), ["a"], 2)
    kept = {(r["source"], r["site"], r["external_id"]): (r["first_seen_at"], r["removed_at"], r["version"]) for r in third.collect()}
    assert kept["a", None, 4] == (at, later, 1) and kept["a", None, 2] == (None, at, None) and kept["a", None, 1] == (None, None, 2)
    metrics = {r["source"]: r for r in sync.run_metrics(kinds, spark.createDataFrame([("a", 3)], "source string, n long"), ["b"]).collect()}
    assert (metrics["a"]["fetched"], metrics["a"]["duplicates"], metrics["a"]["changed"], metrics["a"]["removed"], metrics["a"]["quarantined"]) == (3, 1, 2, 1, 3) and (metrics["b"]["removed"], metrics["b"]["ok"]) == (0, False)
    again = sync.classify(after.select("source", "site", "external_id", "fee", "status", "last_seen_at"), batch)
    assert sync.changed_keys(again, ["a"]).count() == 0  # a second run changes nothing


def test_a_removed_listing_does_not_remove_a_pet_that_another_source_lists(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 2)
    listings = spark.createDataFrame([("a", None, 1, "removed", at), ("b", None, 2, "pending", at), ("a", None, 3, "removed", at)], "source string, site string, external_id long, status string, last_seen_at timestamp")
    links = spark.createDataFrame([("a", None, 1, 10), ("b", None, 2, 10), ("a", None, 3, 11), ("b", None, 9, 12)], "source string, site string, external_id long, pet_id long")
    pets = spark.createDataFrame([(10, "available"), (11, "available"), (12, "available")], "pet_id long, status string")
    changed = listings.filter("source = 'a'").select("source", "site", "external_id")
    registry = spark.createDataFrame([("a", 86400), ("b", 86400)], "source string, interval_s long")
    assert dict(map(tuple, sync.reproject(pets, listings, links, changed, registry, F.lit(at)).collect())) == {10: "pending", 11: "removed", 12: "available"}


def test_organisations_are_made_once(spark):
    names = "source string, external_org_id string, org_name string, city string, state string, postcode string, lat double, lon double"
    listed = spark.createDataFrame([("a", "1", "Known", None, None, None, None, None), ("a", "2", None, "Z", None, None, None, None), ("a", "2", "Second", "A", None, None, 1.0, 2.0), ("b", "1", None, None, None, None, None, None)], names)
    linked, new = sync.upsert_organizations(listed, spark.createDataFrame([("a", "1", 7)], "source string, external_org_id string, organization_id long"))
    ids = {(r["source"], r["external_org_id"]): r["organization_id"] for r in linked.collect()}
    assert ids["a", "1"] == "7" and len(set(ids.values())) == 3 and linked.count() == 4
    assert {(r["organization_id"], r["name"], r["city"]) for r in new.collect()} == {(ids["a", "2"], "Second", "A"), (ids["b", "1"], "Unknown organization", None)}


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from fernspark.staging import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: {"spark.master": "yarn"}.get(key, default))
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf))


def test_snapshot_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source string, v int")
    tables.write_snapshot(df, str(tmp_path / "t"), 1)
    tables.write_snapshot(df.withColumn("v", F.col("v") + 1), str(tmp_path / "t"), 2)
    assert {tuple(r) for r in tables.read_snapshot(spark, str(tmp_path / "t"), 1).select("source", "v").collect()} == {("a", 1), ("b", 2)}
    assert {r["v"] for r in tables.read_snapshot(spark, str(tmp_path / "t"), 2).collect()} == {2, 3}
    tables.replace_sources(df, str(tmp_path / "r"))
    tables.replace_sources(df.filter("source = 'a'").withColumn("v", F.lit(7)), str(tmp_path / "r"))
    assert {(r["source"], r["v"]) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {("a", 7), ("b", 2)}


def test_snapshot_files(spark, tmp_path):
    row = ("asm3:k", "a/b", "k", None, None, "Rex", "dog", "", True, "male", "m", "baby", "x", "true", "unknown", "unknown", "unknown", "unknown", ["t"], None, "available", None, None, None, None, "http://x", ["http://p"])
    names = "source_id external_id org_external_id org_name published_at name species raw_breed_text is_mixed sex size age_group age_confidence house_trained spayed_neutered compat_kids compat_dogs compat_cats traits description status lat lon city state url photos".split()
    kind = {"is_mixed": "boolean", "traits": "array<string>", "photos": "array<string>", "lat": "double", "lon": "double"}
    out = snapshot.export(spark.createDataFrame([row], ", ".join(f"{n} {kind.get(n, 'string')}" for n in names)), F.lit("2024-01-01T00:00:00.000Z"))
    card = out.select("card.*").first()
    assert (card["id"], card["breed_label"], card["org_name"], card["source_label"], card["photo_alt"], card["listed_at"]) == ("asm3-k-a-b", "Mixed breed", "Shelter", "sheltermanager.com", "Rex, a baby Mixed breed", "2024-01-01T00:00:00.000Z")
    snapshot.write(out, str(tmp_path / "s"))
    pet = snapshot.read(spark, str(tmp_path / "s"), out.schema).first()
    assert pet["name"] == "Rex" and pet["lat"] is None and pet["photos"][0]["is_primary"]


LISTING = "pet_id long, status string, species string, age_group string, updated_at long, lat double, lon double, compat_kids string, raw_breed_text string"


def listings(spark):
    rows = [(k, "available" if k % 7 else "pending", "dog" if k % 3 else "cat", ["baby", "adult"][k % 2], k // 4, 10 + k / 50, 20.0 + k / 70, ["true", "false", "unknown"][k % 3], ["50% mix", "Lab_x", None][k % 3]) for k in range(100)]
    return spark.createDataFrame(rows + [(1000, "available", "dog", "baby", 5, None, None, "true", "")], LISTING)


@pytest.mark.parametrize("sort,origin", [("freshness", None), ("distance", (10.5, 20.5))])
def test_pages_join_to_the_whole_order(spark, sort, origin):
    pets = listings(spark).filter("lat IS NOT NULL" if origin else "true")
    seen, after = [], None
    while True:
        rows = search.page(pets, sort, origin, after, 9)
        (value, key), up = search.order_keys(sort, origin)
        ordered = rows.orderBy(*((c.asc() if up else c.desc()) for c in (value, key))).limit(9)
        seen += [r["pet_id"] for r in ordered.collect()]
        after = search.cursor(rows, sort, origin, 9)
        if after is None:
            break
    whole = [r["pet_id"] for r in pets.orderBy(*((c.asc() if up else c.desc()) for c in (value, key))).collect()]
    assert seen == whole


def test_facets_sum_to_the_total(spark):
    got = search.facets(listings(spark)).collect()
    sums = {k: sum(r["n"] for r in got if r["facet"] == k) for k in ("species", "age_group", "total")}
    assert set(sums.values()) == {101}


def test_filters(spark):
    pets = listings(spark)
    n = lambda **want: pets.filter(SearchFilter(**want).predicate()).count()
    every = [r.asDict() for r in pets.collect() if r["status"] == "available"]
    assert n(breed="0% M") == sum("50% mix" == r["raw_breed_text"] for r in every) and n(breed="b_") == sum("Lab_x" == r["raw_breed_text"] for r in every)
    assert n(good_with=["kids"]) == sum(r["compat_kids"] != "false" for r in every) and n(good_with=["kids"], include_unknown_compat=False) == sum(r["compat_kids"] == "true" for r in every)
    assert n(statuses=("available", "pending")) == 101 and n(bbox=(20.0, 10.0, 21.0, 11.0)) == sum(r["lat"] is not None and r["lat"] <= 11 and r["lon"] <= 21 for r in every)
    near = pets.select(search.miles_from(10.5, 20.5).alias("m"), "status").filter("status = 'available' AND m <= 25").count()
    assert n(lat=10.5, lon=20.5, radius=25) == near > 0


def test_an_invalid_field_drops_all(spark):
    df = spark.createDataFrame([("dog", "25", None), ("dog", "30", None), ("cow", "25", "distance")], "species string, radius string, sort string")
    got = filters.validate_filters(df).collect()
    assert [(r["valid"], r["species"], r["radius"], r["sort"]) for r in got] == [(True, "dog", "25", "freshness"), (False, None, "50", "freshness"), (False, None, "50", "freshness")]
    assert got[2]["faults"] == ["species", "sort without place"]


def test_alerts_open_once(spark):
    found = spark.createDataFrame([("dark", "a"), ("dark", None), ("drop", "a")], "kind string, source string")
    known = spark.createDataFrame([("dark", None), ("drop", "b")], "kind string, source string")
    assert {tuple(r) for r in ops.new_alerts(found, known).collect()} == {("dark", "a"), ("drop", "a")}


def test_search_totals_equal_a_plain_join(spark):
    pets = listings(spark)
    searches = spark.createDataFrame([(k, "dog" if k % 2 else "cat", 10.0 + k / 9, 20.0 + k / 9, float([10, 25, 50, 100][k % 4])) for k in range(20)] + [(99, "dog", None, None, 50.0), (98, "emu", None, None, 50.0)], "search_id long, species string, lat double, lon double, radius double")
    got = {r["search_id"]: r["total"] for r in profiles.search_totals(searches, pets).collect()}
    x = pets.withColumnsRenamed({"lat": "la", "lon": "lo"}).join(searches, "species").filter(F.col("lat").isNull() | (geo.haversine_miles(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")) <= F.col("radius")))
    want = {r["search_id"]: r["count"] for r in x.groupBy("search_id").count().collect()}
    assert got == {k: want.get(k, 0) for k in got} and got[98] == 0


def test_fit_notes_keep_rule_order(spark):
    df = spark.createDataFrame([("apartment", "big", "both", "under2", "adventures", "s", "low", "true", "unknown", "false")], "home string, kids string, pets string, hours string, activity string, pet_size string, energy_level string, compat_kids string, compat_dogs string, compat_cats string")
    notes = df.select(profiles.fit_notes(df).alias("n")).first()["n"]
    assert [n["text"] for n in notes] == ["Good fit: apartment living", "Good fit: kids at home", "Ask the shelter: dog compatibility", "Check with the shelter: cats at home"]


def test_takedowns_stay_out(spark):
    old = spark.createDataFrame([(1, "l", "u1", "h1", True, 0), (2, "m", "u9", "", True, 0)], "pet_id long, listing_id string, url string, phash string, is_primary boolean, sort_order int")
    new = spark.createDataFrame([(1, "l", ["bad", "u2", "u1", "u3"])], "pet_id long, listing_id string, urls array<string>")
    got = sync.replace_photos(old, new, spark.createDataFrame([("bad",)], "url string"), 3).collect()
    assert {(r["listing_id"], r["url"], r["phash"], r["is_primary"], r["sort_order"]) for r in got} == {("m", "u9", "", True, 0), ("l", "u2", "", True, 0), ("l", "u1", "h1", False, 1)}


def test_a_large_source_of_a_snapshot_is_written_by_several_tasks(spark, tmp_path):
    from fernspark.sources import tables

    rows = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        at = tables.write_snapshot(rows, str(tmp_path), 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {s: len(list((tmp_path / "generation=00000001" / f"source={s}").glob("*.parquet"))) for s in "ab"}
    assert files["a"] > 1 and sum(files.values()) <= int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    assert spark.read.parquet(at).groupBy("source").count().orderBy("source").collect() == [("a", 18_000), ("b", 2_000)]
