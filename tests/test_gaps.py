"""Raw payloads in quarantine, intervals by site, sweeps that pets follow, removed pets, ties of photos, split blocks and bounded routes."""

import json
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from fernspark.operators import resolve, search, sync
from fernspark.sources import feeds


def at():
    return F.lit("2024-01-10").cast("timestamp")


def test_quarantine_keeps_whole_payloads(spark, tmp_path):
    animals = [{"ID": 5, "ANIMALNAME": "Zoe", "SPECIESNAME": "Dog", "XTRA": {"chip": [1, 2]}}, {"ANIMALNAME": "x", "UNNAMED": "kept"}]
    bodies = {"k": "adoptables = " + json.dumps(animals) + "];", "q": "nothing", "s": "adoptables = [{];"}
    bodies["k"] = bodies["k"].replace("}]];", "}];")
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"account": a, "body": b}) for a, b in bodies.items()))
    registry = spark.createDataFrame([], "account string, name string, city string, region string, lat double, lon double, suppress_descriptions boolean")
    good, bad = feeds.read_widget(spark, str(tmp_path), registry, at())
    raw = {r["source_id"]: r["raw"] for r in bad.collect()}
    assert raw["asm3:q"] == bodies["q"] and raw["asm3:s"] == bodies["s"] and json.loads(raw["asm3:k"]) == animals[1]
    assert json.loads(good.first()["raw"]) == animals[0]


def test_freshness_goes_by_source_and_site(spark):
    links = spark.createDataFrame([(1, "a", "x", "pending", "2024-01-05"), (2, "a", "y", "pending", "2024-01-05"), (3, "a", None, "available", "2024-01-05"), (4, "b", None, "adopted", "2024-01-08")], "pet_id long, source string, site string, status string, last_seen_at string")
    registry = spark.createDataFrame([("a", "x", 2 * 86400), ("a", None, 86400), ("b", "z", 9 * 86400)], "source string, site string, interval_s long")
    assert dict(map(tuple, resolve.reconcile_status(links, registry, at()).collect())) == {1: "pending", 2: "removed", 3: "removed", 4: "adopted"}
    assert dict(map(tuple, resolve.reconcile_status(links, registry.filter("site = 'x'").drop("site"), at()).collect())) == {1: "pending", 2: "pending", 3: "available", 4: "adopted"}


def test_pets_follow_a_sweep(spark):
    listings = spark.createDataFrame([("a", None, "1", "available", "2023-12-01"), ("b", "s", "2", "available", "2024-01-09"), ("a", None, "3", "available", "2023-12-01"), ("a", None, "4", "available", "2024-01-09")], "source string, site string, external_id string, status string, last_seen_at string").withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp"))
    links = spark.createDataFrame([("a", None, "1", 10), ("b", "s", "2", 10), ("a", None, "3", 11), ("a", None, "4", 12)], "source string, site string, external_id string, pet_id long")
    pets = spark.createDataFrame([(10, "available"), (11, "available"), (12, "odd")], "pet_id long, status string")
    registry = spark.createDataFrame([("a", None, 86400), ("b", "s", 86400)], "source string, site string, interval_s long")
    swept, after, alert = sync.sweep(listings, links, pets, registry, "a", at())
    assert dict(map(tuple, after.collect())) == {10: "available", 11: "removed", 12: "odd"}  # another source lists 10, none lists 11, 12 was not swept
    assert alert.first()["n"] == 2 and {r["external_id"] for r in swept.filter("status = 'removed'").collect()} == {"1", "3"}


def test_removed_pets_are_counted_once(spark):
    old = spark.createDataFrame([("a", None, k, "available", "x") for k in "1234"] + [("b", "s", "5", "available", "x")], "source string, site string, external_id string, status string, name string")
    new = spark.createDataFrame([("a", None, "4", "available", "x")], "source string, site string, external_id string, status string, name string")
    links = spark.createDataFrame([("a", None, "1", 7), ("a", None, "2", 7), ("a", None, "3", 8), ("b", "s", "5", 7)], "source string, site string, external_id string, pet_id long")
    none = spark.createDataFrame([], "source string, n long")
    got = {r["source"]: (r["removed"], r["removed_pets"]) for r in sync.run_metrics(sync.classify(old, new), none, (), links).collect()}
    assert got == {"a": (3, 2), "b": (1, 1)}


def test_photos_of_one_order_go_by_their_id(spark):
    photos = spark.createDataFrame([(1, "u2", "b2", True, 0, 9), (1, "u1", "b1", True, 0, 3), (1, "u0", "b0", False, 0, 1)], "pet_id long, url string, blur string, is_primary boolean, sort_order int, photo_id long")
    assert search.first_photo(photos).first()["photo_url"] == "u1" and search.first_photo(photos.withColumn("n", -F.col("photo_id")), ("n",)).first()["photo_url"] == "u2"


@pytest.mark.parametrize("block,few", [(4, True), (4, False), (10_000, True)])
def test_split_blocks_give_all_pairs(spark, monkeypatch, block, few):
    if not few:
        monkeypatch.setattr(resolve, "FEW_BLOCKS", -1)
    rng = random.Random(block)
    rows = [(k, rng.choice(["dog", "cat", None]), rng.choice(["o1", "o1", "o1", "o2", None]), rng.choice([None, 30.0, 30.1]), -90.0, rng.choice([["a"], ["a", "b"], ["b", "a"], ["c"], [], None])) for k in range(90)]
    records = spark.createDataFrame(rows, "pet_id long, species string, org_id string, lat double, lon double, sources array<string>")
    none = spark.createDataFrame([], "pet_a long, pet_b long")
    want = set()
    for a in rows:
        for b in rows:
            near = a[3] is not None and b[3] is not None  # all places are within 25 km
            if a[0] < b[0] and a[1] and a[1] == b[1] and (a[2] is not None and a[2] == b[2] or near) and a[5] is not None and b[5] is not None and set(a[5]) != set(b[5]):
                want.add((a[0], b[0]))
    got = [tuple(r) for r in resolve.candidate_pairs(records, none, none, block=block).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_large_organisation_is_spread_over_tasks(spark):
    """A third of all rows in one organisation: no task makes over twice the median's pairs."""
    rows = spark.range(6000).selectExpr("id AS a", "'dog' AS species", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('o', id) END AS org_id", "concat('s', id % 4) AS kind")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = resolve.unlike_pairs(rows, rows.withColumnsRenamed({"a": "b", "kind": "other"}), ["species", "org_id"], 32)
        made = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(made) == 2000 * 2000 - sum(n * n for n in (500, 500, 500, 500)) and len(made) == 8 and max(made) <= 2 * median(made)


def test_bounded_routes_equal_scores(spark):
    rng = random.Random(8)
    words = "calm gentle loves walks hates rain naps often chases string purrs loudly sits by windows".split()
    story = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([3, 9, 30])))
    base = [dict(species=rng.choice(["cat", "cat", "dog", None]), sex=rng.choice(["male", "female", "unknown", "unknown"]), name=rng.choice(["Tikka", "Tika", "Rex", "", None]), description=rng.choice([story(), None]), raw_breed_text=rng.choice(["Maine Coon", "maine coon mix", "", None]), age_group=rng.choice(["baby", "young", "adult", "odd"]), phashes=rng.choice([[], ["c3a59960f00f1e2d"], ["c3a59960f00f1e2f", "00000000ffffffff"], None])) for _ in range(40)]
    names = ("species", "sex", "name", "description", "raw_breed_text", "age_group", "phashes")
    records = spark.createDataFrame([(k, *(r[n] for n in names)) for k, r in enumerate(base)], "pet_id long, species string, sex string, name string, description string, raw_breed_text string, age_group string, phashes array<string>")
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 40)], "a long, b long")
    key = lambda r: (r["a"], r["b"], r["score"], r["route"], tuple(sorted((k, v) for k, v in r["breakdown"].items() if v is not None)))
    every = resolve.pair_scores(pairs, records).filter("NOT vetoed").collect()
    read = []
    original, resolve.staged = resolve.staged, lambda df, name: (lambda out: read.append((name, out.count())) or out)(original(df, name))
    try:
        kept = resolve.routed_pairs(pairs, records).collect()
    finally:
        resolve.staged = original
    assert {key(r) for r in kept} == {key(r) for r in every if r["route"] != "drop"} and 20 < len(kept)
    assert len(kept) <= dict(read)["likely-pairs"] < dict(read)["hopeful-pairs"] < len(every)


def test_no_task_has_more_edges_and_pairs_than_the_limit(spark, monkeypatch):
    """One component with few edges and far more forbidden pairs, against taking edges from the strongest on."""
    rng, n, limit = random.Random(12), 160, 60
    edges = {}
    for k in range(1, n):
        edges[rng.randrange(k), k] = 0.0
    while len(edges) < 420:
        a, b = sorted(rng.sample(range(n), 2))
        edges[a, b] = 0.0
    rows = [(a, b, 1 - i / 1000) for i, (a, b) in enumerate(rng.sample(sorted(edges), len(edges)))]
    never = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(2500)} - {(a, b) for a, b, s in rows if s > 0.9}
    whole = resolve._kept_apart

    def bounded(table):
        kinds = table.column("kind").to_pylist()
        if len(kinds) - kinds.count("node") > limit or kinds.count("node") > 2 * limit:
            raise ValueError(f"{len(kinds)} rows in one task")
        return whole(table)

    monkeypatch.setattr(resolve, "_kept_apart", bounded)
    got = dict(map(tuple, resolve.clusters(spark.createDataFrame(rows, "a long, b long, score double"), spark.createDataFrame(sorted(never), "pet_a long, pet_b long"), limit=limit).collect()))
    group, final = {k: {k} for k in range(n)}, set()
    for a, b, _ in sorted(rows, key=lambda r: -r[2]):
        x, y = group[a], group[b]
        if x is y:
            continue
        if id(x) in final or id(y) in final or any(tuple(sorted((u, v))) in never for u in x for v in y):
            final |= {id(x), id(y)}
            continue
        x |= y
        for k in y:
            group[k] = x
    assert got == {k: min(g) for k, g in group.items()} and len(set(got.values())) > 5
