"""Totals of saved searches against the predicate of each one."""

import random

import pytest
from pyspark.sql import functions as F

from fernspark.operators import predicates, profiles
from fernspark.operators.search import SearchFilter

PETS = "pet_id long, status string, species string, sex string, age_group string, size string, energy_level string, coat_length string, house_trained string, compat_kids string, compat_dogs string, compat_cats string, raw_breed_text string, lat double, lon double"
SEARCHES = "search_id long, species string, sex string, age_group array<string>, size array<string>, energy array<string>, coat array<string>, house_trained boolean, good_with array<string>, include_unknown_compat boolean, breed string, bbox string, lat double, lon double, radius double"


def made(rng):
    known = ["true", "false", "unknown", None]
    place = lambda: rng.choice([(rng.uniform(30, 40), rng.uniform(-100, -90)), (rng.uniform(-1, 1), rng.choice([-179.9, 179.9, 180.0, -180.0])), (rng.uniform(88.5, 90), rng.uniform(-180, 180)), (None, None)])
    breeds = ["Labrador Mix", "beagle", "Ärgernis ab", "a", "", None, "Lab/Beagle", "100%_pure"]
    pets = [(k, "available", rng.choice(["dog", "cat", "emu", None]), rng.choice(["male", "female", "unknown"]), rng.choice(["baby", "adult", None]), rng.choice(["s", "m", "l"]), rng.choice(["low", "high"]), rng.choice(["short", "wire"]), *(rng.choice(known) for _ in range(4)), rng.choice(breeds), *place()) for k in range(600)]
    maybe = lambda x, p=0.25: x if rng.random() < p else None
    searches = []
    for k in range(220):
        lat, lon = (rng.uniform(30, 40), rng.uniform(-100, -90)) if k % 3 == 0 else (rng.uniform(-1, 1), rng.choice([179.8, -179.8])) if k % 7 == 0 else (rng.uniform(88.8, 89.9), rng.uniform(-180, 180)) if k % 11 == 0 else (None, None)
        box = rng.choice(["30.5,31.5,32.5,33.5", "-99.5,31,-92.25,38.5", "-180,-90,180,90", "10,5,9,6", "-100,30,-99,90"]) if k % 5 == 1 else None
        searches.append((k, maybe(rng.choice(["dog", "cat"]), 0.6), maybe("male"), maybe(rng.sample(["baby", "adult", "senior"], 2)), maybe(rng.choice([["s"], ["m", "l"], []])), maybe(["low"]), maybe(["wire", "curly"]), maybe(rng.random() < 0.5), maybe(rng.sample(["kids", "dogs", "cats"], 2)), maybe(False, 0.5), maybe(rng.choice(["lab", "B", "ÄR", "a", "beagle m", "%", "zzz"]), 0.3), box, lat, lon, rng.choice([10.0, 25.0, 50.0, 100.0, None])))
    return pets, searches + [(300, *searches[0][1:]), (301, *searches[1][1:])]


def plain(spark, pets, searches):
    out = {}
    for s in searches:
        (k, species, sex, ages, sizes, energy, coat, house, good, unknown, breed, box, lat, lon, radius) = s
        ask = SearchFilter(species=species, breed=breed, age_group=ages or [], size=sizes or [], sex=sex, energy=energy or [], coat=coat or [], house_trained=house, good_with=good or [], include_unknown_compat=unknown is None or unknown, bbox=tuple(map(float, box.split(","))) if box else None, lat=lat, lon=lon, radius=50.0 if radius is None else radius)
        out[k] = F.sum(ask.predicate().cast("long")).alias(str(k))
    row = pets.agg(*out.values()).first()
    return {k: row[str(k)] or 0 for k in out}


@pytest.mark.parametrize("few", [True, False])
def test_totals_equal_each_predicate(spark, monkeypatch, few):
    if not few:  # without broadcasts
        monkeypatch.setattr(predicates, "FEW_KEYS", -1)
        monkeypatch.setattr(predicates, "FEW_SEARCHES", -1)
    rows, asked = made(random.Random(1 + few))
    pets, searches = spark.createDataFrame(rows, PETS), spark.createDataFrame(asked, SEARCHES)
    got = profiles.search_totals(searches, pets)
    assert got.columns == [*searches.columns, "total"]
    found = {r["search_id"]: r["total"] for r in got.collect()}
    assert found == plain(spark, pets, asked) and sum(found.values()) > 1000


def test_searches_and_pets_of_one_cell_meet_in_tiles_not_in_pairs(spark, monkeypatch):
    """Tiles of a few rows give the same totals, and counting makes no row for a pet and a search."""
    for name, most in {"TILE_PETS": 3, "TILE_SEARCHES": 2, "TILE_CELLS": 4, "ANSWERS": 0}.items():
        monkeypatch.setattr(predicates, name, most)
    rows, asked = made(random.Random(5))
    rows, asked = rows[:120], asked[:60]
    got = profiles.search_totals(spark.createDataFrame(asked, SEARCHES), spark.createDataFrame(rows, PETS))
    assert {r["search_id"]: r["total"] for r in got.collect()} == plain(spark, spark.createDataFrame(rows, PETS), asked)


def test_lists_as_text_missing_columns_and_empty_tables(spark):
    pets = spark.createDataFrame([(1, "dog", "baby"), (2, "dog", "adult"), (3, "cat", None)], "pet_id long, species string, age_group string")
    searches = spark.createDataFrame([(1, "", "baby,adult", ""), (2, "cat", "", "kids"), (3, None, None, None), (4, "dog", None, "kids")], "search_id long, species string, age_group string, good_with string")
    total = lambda s, p: {r["search_id"]: r["total"] for r in profiles.search_totals(s, p).collect()}
    assert total(searches, pets) == {1: 2, 2: 1, 3: 3, 4: 2}
    assert total(searches, pets.limit(0)) == {1: 0, 2: 0, 3: 0, 4: 0} and total(searches.limit(0), pets) == {}
    strict = searches.withColumn("include_unknown_compat", F.lit(False))
    assert total(strict, pets) == {1: 2, 2: 0, 3: 3, 4: 0}


def test_no_pairs_of_all_searches_and_pets(spark):
    rows, asked = made(random.Random(3))
    joins = []
    original = predicates.staged
    try:
        predicates.staged = lambda df, name: joins.append(df._jdf.queryExecution().executedPlan().toString()) or original(df, name)
        profiles.search_totals(spark.createDataFrame(asked, SEARCHES), spark.createDataFrame(rows, PETS))
    finally:
        predicates.staged = original
    assert joins and not any("NestedLoop" in x or "Cartesian" in x for x in joins)
