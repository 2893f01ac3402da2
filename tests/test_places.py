"""Places in Z-order: what a radius finds, and what it reads."""

import random

from pyspark.sql import functions as F

from fernspark.functions.geo import within
from fernspark.sources import places


def files_read(df):
    """Rows found, and how many of the table's files the scan read."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    scans = [leaves.apply(k) for k in range(leaves.size())]
    return rows, sum(x.metrics().apply("numFiles").value() for x in scans if x.metrics().contains("numFiles"))


def test_a_radius_reads_few_files_and_finds_all(spark, tmp_path):
    rng = random.Random(4)
    spots = [(30.0, -95.0), (0.0, 180.0), (0.1, -179.99), (89.5, 20.0), (-89.9, 0.0), (45.0, 0.0)]
    rows = [(k, *(None, None)) if k % 50 == 0 else (k, rng.uniform(10, 60), rng.uniform(-130, -30)) if k % 3 else (k, *(c + rng.uniform(-0.5, 0.5) for c in rng.choice(spots))) for k in range(1500)]
    rows += [(6000, 90.0, 180.0), (6001, -90.0, -180.0), (6002, None, 3.0)]
    spots = [(30.0, -95.0), *spots[1:5]]
    rows = [(k, None if a is None else max(-90.0, min(90.0, a)), None if b is None else max(-180.0, min(180.0, b))) for k, a, b in rows]
    pets = spark.createDataFrame(rows, "pet_id long, lat double, lon double")
    at = str(tmp_path / "places")
    places.write_places(pets, at, 16)
    every = len([*tmp_path.rglob("*.parquet")])
    assert every > 150 and spark.read.parquet(at).count() == len(rows)
    for lat, lon in spots:
        for miles in (25.0, 1500.0) if lat else (25.0,):
            found, read = files_read(places.near(spark, at, lat, lon, miles))
            want = {r["pet_id"] for r in pets.filter(within(F.col("lat"), F.col("lon"), lat, lon, miles)).collect()}
            assert {r["pet_id"] for r in found} == want and len(found) == len(want)
            if miles == 25 and abs(lat) < 80:
                assert want and read < 0.05 * every


def test_ranges_hold_their_box_and_little_else():
    rng = random.Random(6)
    for _ in range(50):
        south, west = rng.uniform(-80, 79), rng.uniform(-170, 160)
        north, east = south + rng.uniform(0, 3), west + rng.uniform(0, 3)
        ranges = places.z_ranges(south, west, north, east)
        assert all(a <= b for a, b in ranges) and all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:])) and len(ranges) <= 4 * places.RANGES
        cell = lambda v, low, size: int((v - low) / size * 65536)
        for _ in range(30):
            y, x = cell(rng.uniform(south, north), -90, 180), cell(rng.uniform(west, east), -180, 360)
            z = sum((y >> k & 1) << 2 * k + 1 | (x >> k & 1) << 2 * k for k in range(16))
            assert any(a <= z <= b for a, b in ranges)
        area = (cell(north, -90, 180) - cell(south, -90, 180) + 1) * (cell(east, -180, 360) - cell(west, -180, 360) + 1)
        assert sum(b - a + 1 for a, b in ranges) < 6 * area + 5000
