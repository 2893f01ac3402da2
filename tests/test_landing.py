"""Landed payload files: lots as a data source, and the state and quarantine that a stream makes of them."""

import json

from pyspark.sql import functions as F

from fernspark.sources import feeds, landing
from fernspark.streaming import streams

REGISTRY = "account string, name string, city string, region string, lat double, lon double, suppress_descriptions boolean"


def script(*animals):
    return f"var adoptables = {json.dumps([{'ID': k, 'ANIMALNAME': name, 'SPECIESNAME': 'Dog', 'BREEDNAME': 'Mix'} for k, name in animals])}; // end"


def land(spark, path, payloads, complete, day):
    landing.land(spark.createDataFrame([(f"asm3:{a}" if a else None, body) for a, body in payloads], "source string, body string"), path, f"2024-01-{day:02d}T00:00:00", [f"asm3:{a}" for a in complete])


def test_lots_are_read_by_their_markers(spark, tmp_path):
    path = str(tmp_path / "in")
    assert landing.lots_landed(path) == 0 and landing.landed(spark, path).count() == 0
    land(spark, path, [("a", "x é"), ("b", ""), (None, "y"), ("a", "x é")], ["a", "silent"], 1)
    land(spark, path, [], [], 2)  # an empty lot
    land(spark, path, [("a", "z" * (3 << 20))], ["a"], 3)  # larger than a partition, below
    (tmp_path / "in" / "lots" / "00000000" / "stray").write_text("of a failed attempt")
    (tmp_path / "in" / "_landed" / "00000007.json").write_text("{}")  # after a gap: not there yet
    assert landing.lots_landed(path) == 3
    got = landing.landed(spark, path)
    assert got.schema == spark.createDataFrame([], landing.SCHEMA).schema
    rows = sorted((r["lot"], r["source"] or "", r["body"] or "", r["complete"], r["file"] is None, r["error"]) for r in got.collect())
    assert rows == [(0, "", "y", False, False, None), (0, "asm3:a", "x é", True, False, None), (0, "asm3:a", "x é", True, False, None), (0, "asm3:b", "", False, False, None), (0, "asm3:silent", "", True, True, None), (2, "asm3:a", "z" * (3 << 20), True, False, None)]
    assert landing.landed(spark, path, 1, 2).count() == 0 and landing.landed(spark, path, 2).count() == 1
    small = spark.read.format(landing.FORMAT).option("partitionBytes", 1 << 20).load(path)
    assert small.rdd.getNumPartitions() == 2 and small.count() == 6
    assert {r["run_at"].isoformat() for r in got.filter("lot = 2").select(F.date_format("run_at", "yyyy-MM-dd").cast("date").alias("run_at")).collect()} == {"2024-01-03"}


def test_payloads_that_cannot_be_read(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, [("a", "1"), ("b", "2")], [], 1)
    files = {r["source"]: tmp_path / "in" / r["file"] for r in landing.landed(spark, path).collect()}
    files["asm3:a"].write_bytes(b"caf\xe9")
    files["asm3:b"].unlink()
    assert {r["source"]: (r["body"], r["error"]) for r in landing.landed(spark, path).collect()} == {"asm3:a": ("caf\\xe9", "payload not UTF-8"), "asm3:b": (None, "payload missing")}


def test_a_source_that_cannot_be_read_loses_nothing(spark, tmp_path):
    path, state, bad, check = (str(tmp_path / x) for x in ("in", "state", "bad", "check"))
    registry = spark.createDataFrame([], REGISTRY)

    def parse(rows):
        good, quarantine = feeds.widget_feed(rows, registry, F.lit("2024-01-01").cast("timestamp"))
        return good.select(F.col("source_id").alias("source"), F.lit(None).cast("string").alias("site"), "external_id", "name", "photos", "status"), quarantine

    def run(checkpoint=check):
        streams.run_feed(spark, path, state, bad, checkpoint, parse, buckets=2).awaitTermination()
        n = landing.lots_landed(path)
        rows = streams.read_state(spark, state, streams.state_schema(parse(landing.landed(spark, path, 0, 0))[0]), n).collect()
        return {(r["source"][5:], r["external_id"]): (r["name"], r["status"], r["last_seen_at"].day) for r in rows}

    land(spark, path, [(a, script((1, "Ann"), (2, "Bo"))) for a in "abcde"], "abcde", 1)
    first = run()
    assert first == {(a, k): (name, "available", 1) for a in "abcde" for k, name in (("1", "Ann"), ("2", "Bo"))}
    # a: complete; b: one of its payloads has no end; c: complete and silent; d: not complete; e: only a bad animal is left out
    land(spark, path, [("a", script((1, "Ann"))), ("b", script((1, "New"))), ("b", "var adoptables = [{"), ("d", script((1, "Dee"))), ("e", script((1, "Ann"), (None, "No id")))], "abce", 2)
    land(spark, path, [("a", script((3, "Cy"), (3, "Di")))], [], 3)  # both lots in one micro-batch, and a key that comes twice
    second = run()
    expected = first | {("a", "1"): ("Ann", "available", 2), ("a", "2"): ("Bo", "removed", 1), ("b", "1"): ("New", "available", 2), ("c", "1"): ("Ann", "removed", 1), ("c", "2"): ("Bo", "removed", 1), ("d", "1"): ("Dee", "available", 2), ("e", "1"): ("Ann", "available", 2), ("e", "2"): ("Bo", "removed", 1), ("a", "3"): ("Di", "available", 3)}
    assert second == expected
    held = {(r["lot"], r["source_id"], r["external_id"], tuple(r["reasons"]), r["raw"]) for r in spark.read.parquet(bad).collect()}
    assert {h[:4] for h in held} == {(1, "asm3:b", None, ("payload not terminated",)), (1, "asm3:e", None, ("missing id",))} and "var adoptables = [{" in {h[4] for h in held}
    assert run() == expected  # nothing new
    assert run(str(tmp_path / "other")) == expected  # all lots again, without a checkpoint: each counts once


def test_an_account_that_lost_all_its_payloads_loses_no_listing(spark, tmp_path):
    """With 9 suppliers accounts go by threes with identifiers, so every sixth sends nothing in the second lot."""
    import duckdb

    from fernspark.plans import stream_queries

    con = duckdb.connect()
    for name, rows in (("supplier", 9), ("part", 200), ("nation", 25)):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(rows).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(str, map(tuple, stream_queries.stream_landed_feed(spark, str(tmp_path)).select("kind", "source", "what", "n", "ids").collect())))
    want = con.execute(f"SELECT kind, source, what, n, ids FROM ({stream_queries.QUERIES[stream_queries.stream_landed_feed]})").fetchall()
    assert got == sorted(map(str, want)) and len(got) > 20


def test_small_payloads_share_files(spark, tmp_path):
    path = str(tmp_path / "in")
    given = [(f"asm3:{k}", f"é{k}" * k) for k in range(40)] + [("asm3:long", "z" * (3 << 20)), (None, None)]
    rows = spark.createDataFrame(given, "source string, body string").coalesce(1)
    landing.land(rows, path, "2024-01-01T00:00:00", spark.createDataFrame([("asm3:7",), ("asm3:silent",), ("asm3:silent",), (None,)], "source string"))
    got = landing.landed(spark, path).collect()
    assert sorted((str(r["source"]), r["body"]) for r in got if r["file"]) == sorted((str(s), b or "") for s, b in given)
    assert {r["source"] for r in got if r["complete"]} == {"asm3:7", "asm3:silent"} and [r["source"] for r in got if not r["file"]] == ["asm3:silent"]
    files = {r["file"] for r in got if r["file"]}
    assert len(files) == 2 and {r["source"] for r in got if r["file"] == max(files, key=lambda f: (tmp_path / "in" / f).stat().st_size)} == {"asm3:long"}
    shared = tmp_path / "in" / min(files, key=lambda f: (tmp_path / "in" / f).stat().st_size)
    shared.write_bytes(shared.read_bytes()[:-1])  # the last payload that has bytes lost one
    after = {r["source"]: (r["body"], r["error"]) for r in landing.landed(spark, path).collect()}
    assert [s for s, (_, e) in after.items() if e] and all(e in (None, "payload cut short") for _, e in after.values()) and after["asm3:20"] == ("é20" * 20, None)
    shared.unlink()
    assert sum(r["error"] == "payload missing" for r in landing.landed(spark, path).collect()) == 41


def test_the_driver_holds_no_list_of_payloads_or_sources(spark, tmp_path):
    """The marker and the manifest are as large for 500 sources as for few."""
    path, state, bad, check = (str(tmp_path / x) for x in ("in", "state", "bad", "check"))
    registry, n = spark.createDataFrame([], REGISTRY), 500

    def parse(rows):
        good, quarantine = feeds.widget_feed(rows, registry, F.lit("2024-01-01").cast("timestamp"))
        return good.select(F.col("source_id").alias("source"), F.lit(None).cast("string").alias("site"), "external_id", "name", "status"), quarantine

    every = spark.range(n).select(F.concat(F.lit("asm3:"), "id").alias("source"))
    lots = [[(f"asm3:{k}", script((1, "Ann"), (2, "Bo"))) for k in range(n)], [(f"asm3:{k}", script((1, "Ann"))[: 30 if k % 10 == 0 else None]) for k in range(0, n, 2)]]
    for day, lot in enumerate(lots, 1):
        landing.land(spark.createDataFrame(lot, "source string, body string").coalesce(2), path, f"2024-01-{day:02d}T00:00:00", every)
        streams.run_feed(spark, path, state, bad, check, parse, buckets=2, groups=3).awaitTermination()
    assert max(x.stat().st_size for x in (tmp_path / "in" / "_landed").glob("*.json")) < 3000
    assert sum(1 for x in (tmp_path / "in" / "lots").rglob("*") if x.is_file()) < 60
    assert len(streams._manifest(spark, state, 2)) <= 6
    rows = streams.read_state(spark, state, streams.state_schema(parse(landing.landed(spark, path, 0, 0))[0]), 2).collect()
    got = {(int(r["source"][5:]), r["external_id"]): r["status"] for r in rows}
    assert got == {(k, i): "available" if k % 10 == 0 or i == "1" and k % 2 == 0 else "removed" for k in range(n) for i in "12"}
