"""Streams in lots, against their batch twins; state that is written by slots; merges as a log."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import pytest

from fernspark.operators import history, ops
from fernspark.streaming import streams

DAY = datetime(2024, 1, 1)


def test_suppression_by_lots_equals_its_batch_twin(spark, tmp_path):
    rng = random.Random(2)
    lots = [[(rng.randrange(12), "report", f"u{rng.randrange(6)}", DAY + timedelta(hours=24 * k + rng.randrange(24)), None) for _ in range(25)] for k in range(4)]
    for k, lot in enumerate(lots):
        lot += [(rng.randrange(12), "change", None, DAY + timedelta(hours=24 * k + rng.randrange(24)), "available") for _ in range(3 * (k > 0))]
    lots[2].append((3, "report", "late", DAY, None))  # arrives after later events
    lots[3] += lots[3][:5]  # repeated rows
    path, seen, alerts = str(tmp_path / "out"), [], set()
    for lot in lots:
        spark.createDataFrame(lot, streams.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.run_suppression(spark.readStream.schema(streams.EVENTS).parquet(str(tmp_path / "in")), path, str(tmp_path / "check")).awaitTermination()
        seen += lot
        every = spark.createDataFrame(seen, streams.EVENTS)
        reports = every.filter("kind = 'report'").select("pet_id", "fingerprint", F.col("at").alias("created_at"), F.lit(False).alias("resolved"))
        changed = every.filter("kind = 'change'").groupBy("pet_id").agg(F.max("at").alias("changed_at"))
        twin = {r["pet_id"]: r["reporters"] for r in ops.report_suppression(reports, changed).collect()}
        alerts |= set(twin)
        decided = streams.decisions(spark, path)
        last = decided.groupBy("pet_id").agg(F.max_by(F.struct("reporters", "suppressed"), "batch").alias("d")).filter("d.suppressed").collect()
        assert {r["pet_id"]: r["d"]["reporters"] for r in last} == twin
    raised = [r["pet_id"] for r in decided.filter("alert").collect()]
    assert sorted(raised) == sorted(alerts) and len(alerts) > 2
    pets = spark.createDataFrame([(k, "pending") for k in range(13)], "pet_id long, status string")
    status = dict(map(tuple, streams.suppressed_pets(pets, decided).collect()))
    touched = {r[0] for r in seen if r[1] == "change"}
    assert status == {k: "removed" if k in twin else "available" if k in touched else "pending" for k in range(13)}


def test_a_resolution_closes_the_alert(spark, tmp_path):
    report = lambda who, hour: (1, "report", who, DAY + timedelta(hours=hour), None)
    lots = [[report("a", 1), report("b", 1), report("c", 1)], [report("d", 2)], [(1, "resolve", None, DAY + timedelta(hours=3), None)], [report("a", 4), report("b", 4), report("c", 5)]]
    for lot in lots:
        spark.createDataFrame(lot, streams.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.run_suppression(spark.readStream.schema(streams.EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = streams.decisions(spark, str(tmp_path / "out")).orderBy("batch").collect()
    assert [(r["reporters"], r["suppressed"], r["alert"]) for r in got] == [(3, True, True), (4, True, False), (0, False, False), (3, True, True)]


def test_a_micro_batch_of_events_writes_the_slots_of_its_pets_only(spark, tmp_path):
    report = lambda pet, who, hour: (pet, "report", who, DAY + timedelta(hours=hour), None)
    lots = [[report(k, w, 1) for k in (*range(40), None) for w in "ab"], [report(7, "c", 2), report(None, "c", 2), (8, "change", None, DAY, "adopted")], [report(7, "a", 3)]]
    at, out = str(tmp_path / "out" / "_state"), str(tmp_path / "out")
    for lot in lots:
        spark.createDataFrame(lot, streams.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.run_suppression(spark.readStream.schema(streams.EVENTS).parquet(str(tmp_path / "in")), out, str(tmp_path / "check"), buckets=16).awaitTermination()
    slots = {k: b for k, (_, b) in streams._manifest(spark, at, 3).items()}
    assert sum(b == 3 for b in slots.values()) == 1 and sum(b == 1 for b in slots.values()) >= 5
    got = {(r["batch"], r["pet_id"]): (r["reporters"], r["suppressed"], r["alert"], r["status"]) for r in streams.decisions(spark, out).filter("batch > 0").collect()}
    assert got == {(1, 7): (3, True, True, None), (1, None): (3, True, True, None), (1, 8): (2, False, False, "adopted"), (2, 7): (3, True, False, None)}


FEED = "source string, site string, external_id string, status string, name string, run_at timestamp, complete boolean"


def test_a_lot_rewrites_its_own_slots_only(spark, tmp_path):
    at = lambda d: DAY + timedelta(days=d)
    path, check, landed = (str(tmp_path / x) for x in ("state", "check", "in"))
    first = spark.createDataFrame([(s, None, str(k), "available", "n", at(0), at(0), None, 1) for s in ("a", "b", "c:d/e") for k in range(20)], "source string, site string, external_id string, status string, name string, last_seen_at timestamp, first_seen_at timestamp, removed_at timestamp, version int")
    schema = streams.state_schema(spark.createDataFrame([], FEED))

    def land(rows, first=None):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(landed)
        streams.run_sync(spark.readStream.schema(FEED).parquet(landed), path, check, first, buckets=4).awaitTermination()

    land([("a", None, str(k), "available", "n", at(1), True) for k in range(15)] + [("a", None, "new", "available", "n", at(1), True)], first)
    slots = [streams._manifest(spark, path, n) for n in (0, 1)]
    assert {v for k, v in slots[1].items() if v[0] != "a"} == {(s, 0) for s in ("b", "c:d/e")} and {v[1] for v in slots[1].values() if v[0] == "a"} == {1}
    land([("b", None, "3", "pending", "n", at(2), False)])  # not complete: one slot, nothing removed
    two = streams._manifest(spark, path, 2)
    assert [k for k in two if two[k] != slots[1][k]] == [k for k, v in two.items() if v[1] == 2] and sum(v[1] == 2 for v in two.values()) == 1
    state = {(r["source"], r["external_id"]): r for r in streams.read_state(spark, path, schema, 2).collect()}
    assert len(state) == 61 and state["a", "17"]["status"] == "removed" and state["a", "17"]["removed_at"] == at(1) and state["a", "3"]["last_seen_at"] == at(1)
    assert state["b", "3"]["status"] == "pending" and state["b", "4"]["status"] == "available" and state["c:d/e", "3"]["last_seen_at"] == at(0)
    land([("c:d/e", None, "1", "available", "n", at(3), True)])
    left = {x.name for x in (tmp_path / "state" / "data" / "batch=00000000").glob("slot=*")}
    assert left == {f"slot={k}" for m in (streams._manifest(spark, path, n) for n in (2, 3)) for k, v in m.items() if v[1] == 0}  # what neither of the last two manifests names is gone
    again = streams.read_state(spark, path, schema, 3)
    assert again.count() == 61 and again.filter("source = 'c:d/e' AND status = 'removed'").count() == 19


def plain_owner(log, upto):
    last = {}
    for seq, kind, loser, winner in sorted(log):
        if seq <= upto:
            last[loser] = winner if kind == "merge" else None
    def root(x):
        while last.get(x) is not None:
            x = last[x]
        return x
    return root, {k for k, v in last.items() if v is not None}


def test_a_log_of_merges_is_folded_to_any_event(spark):
    rng, log, n = random.Random(5), [], 30
    for seq in range(1, 80):  # merges of pets that stand for themselves, and unmerges in any order
        root, gone = plain_owner(log, seq)
        if rng.random() < 0.35 and gone:
            log.append((seq, "unmerge", rng.choice(sorted(gone)), 0))
        else:
            a, b = rng.sample(range(n), 2)
            if root(a) == a and root(b) != a:
                log.append((seq, "merge", a, b))
    table = spark.createDataFrame(log, "seq long, kind string, loser long, winner long")
    pets = spark.createDataFrame([(k, "available", "male" if k % 3 else "unknown", f"text {k}" * (k % 5), [f"t{k % 4}"]) for k in range(n)], "pet_id long, status string, sex string, description string, traits array<string>")
    links = spark.createDataFrame([(k, "s", "pending" if k % 2 else "available", DAY, f"l{k}{j}") for k in range(n) for j in range(2)], "pet_id long, source string, status string, last_seen_at timestamp, listing_id string")
    photos = spark.createDataFrame([(k, f"u{k}") for k in range(n)], "pet_id long, url string")
    standing = spark.createDataFrame([(k, 1, k % 7) for k in range(n)], "pet_id long, trust int, last_seen int")
    registry = spark.createDataFrame([("s", 86400)], "source string, interval_s long")
    for upto in (0, 20, 50, 79):
        root, gone = plain_owner(log, upto)
        after, mine, pictures = history.state_at(table, upto, pets, links, photos, standing, registry, F.lit(DAY))
        got = {r["pet_id"]: r for r in after.collect()}
        assert set(got) == set(range(n)) - gone
        for k, r in got.items():
            members = sorted((x for x in range(n) if root(x) == k), key=lambda x: (x != k, -(x % 7), x))
            texts = [f"text {x}" * (x % 5) for x in members]
            assert r["members"] == len(members) and r["traits"] == sorted({f"t{x % 4}" for x in members}) and len(r["description"]) == max(map(len, texts))
            assert r["sex"] == next(("male" for x in members if x % 3), "unknown") and r["status"] == ("available" if len(members) == 1 or not any(x % 2 for x in members) else "pending")
        assert {(r["pet_id"], r["listing_id"]) for r in mine.collect()} == {(root(k), f"l{k}{j}") for k in range(n) for j in range(2)}
        assert {tuple(r) for r in pictures.collect()} == {(root(k), f"u{k}") for k in range(n)}
    undo = [(100 + i, "unmerge", k, 0) for i, k in enumerate(rng.sample(range(n), n))]  # all are taken back, in any order
    whole = history.state_at(spark.createDataFrame(log + undo, table.schema), None, pets, links, photos, standing, registry, F.lit(DAY))
    assert [sorted(map(str, x.select(*y.columns).collect())) for x, y in zip(whole, (pets, links, photos))] == [sorted(map(str, y.collect())) for y in (pets, links, photos)]
    with pytest.raises(ValueError, match="circle"):
        history.owners(spark.createDataFrame([(1, 2), (2, 1)], "loser long, winner long"))


def test_alerts_read_a_week_and_the_latest_runs(spark, tmp_path):
    schema = "source string, run_id long, finished_at timestamp, ok boolean, fetched long, quarantined long"
    rng, rows, got = random.Random(3), [], {}
    lots = [[(s, 1000 * day + 10 * k + i, DAY + timedelta(days=day, hours=3 * k), rng.random() < 0.8, rng.choice([100, 90, 20, 0]), rng.choice([0, 5, 40])) for i, s in enumerate("abc") for k in range(3)] for day in range(0, 24, 2)]
    lots[5] += lots[2]  # runs that come again
    path = str(tmp_path / "state")
    for n, lot in enumerate(lots):
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.run_alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, lambda df, k: got.update({k: {tuple(r) for r in df.select("kind", "source").collect()}}), str(tmp_path / "check")).awaitTermination()
        rows = list(dict.fromkeys(rows + lot))
        every, now = spark.createDataFrame(rows, schema), max(r[2] for r in lot)
        nothing = every.select("source").limit(0)
        twin = ops.count_drop(every, F.lit(now), nothing).select("kind", "source").unionByName(ops.validation_failures(every, nothing).select("kind", "source"))
        assert got[n] == {tuple(r) for r in twin.collect()}
    assert sum(map(len, got.values())) > 10 and len(got) == len(lots)
    assert spark.read.parquet(f"{path}/latest/batch={len(lots) - 1}").count() == 3


def test_tasks_of_a_replay_follow_its_rows(spark, monkeypatch):
    monkeypatch.setattr(history, "TASK_ROWS", 10)
    n = 60
    log = spark.createDataFrame([(k, "merge", k, k - 1) for k in range(1, n, 3)], "seq long, kind string, loser long, winner long")
    pets = spark.createDataFrame([(k, "available", "male") for k in range(n)], "pet_id long, status string, sex string")
    links = spark.createDataFrame([(k % n, "s", "pending", DAY) for k in range(2 * n)], "pet_id long, source string, status string, last_seen_at timestamp")
    photos = spark.createDataFrame([(k, f"u{k}") for k in range(n)], "pet_id long, url string")
    standing = spark.createDataFrame([(k, 1, 0) for k in range(n)], "pet_id long, trust int, last_seen int")
    registry = spark.createDataFrame([("s", 86400)], "source string, interval_s long")
    after, mine, pictures = history.state_at(log, None, pets, links, photos, standing, registry, F.lit(DAY))
    assert mine.count() == 2 * n and pictures.count() == n and after.count() == n - n // 3
    assert {history.dealt(x, "pet_id", links, photos).rdd.getNumPartitions() for x in (after, mine)} == {12}
    assert all("REPARTITION_BY_NUM" in x._jdf.queryExecution().executedPlan().toString() for x in (after, mine, pictures))
