"""Web archives, conversation repair and vector codes against plain versions."""

import gzip
import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

from fernspark.llm import repair, vector_codes, warc

# Conversation repair


def plain_edges(state, row):
    """All ways to consume a row from a state: letters, cost, next state."""
    go = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
    for n in range(4):
        at = state
        for _ in range(n):
            at = go[at]
        lead, cost = "I" * n, 5 * n
        yield lead + "D", cost + 2, at
        if not row & 4:
            stays = 5 * (row >> 3 & 1)
            yield lead + "R", cost + 1 + stays, go[at]
            if (at, row & 3) in keeps:
                yield lead + "K", cost + stays, keeps[at, row & 3]


def brute_audit(rows):
    """By trying every sequence of edits."""
    paths = [("", 0, 0)]
    for row in rows:
        paths = [(x + letters, c + cost, to) for x, c, s in paths for letters, cost, to in plain_edges(s, row)]
    ends = [(c + 5 * n, x + "I" * n) for x, c, s in paths for n in range(4) if _accepts(s, n)]
    return min(ends)


def _accepts(state, n):
    for _ in range(n):
        state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
    return state in (0, 3)


def whole_audit(rows):
    """By carrying the least audit of each state along, as whole strings."""
    best = {0: (0, "")}
    for row in rows:
        new = {}
        for s, (c, x) in best.items():
            for letters, cost, to in plain_edges(s, row):
                new[to] = min(new.get(to, (1 << 60, "")), (c + cost, x + letters))
        best = new
    return min((c + 5 * n, x + "I" * n) for s, (c, x) in best.items() for n in range(3) if _accepts(s, n))


def test_audit_is_the_least_of_all():
    rng = random.Random(3)
    for _ in range(150):
        rows = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 6, 9, 10, 8]) for _ in range(rng.randint(0, 4)))
        assert (repair.audit_cost(repair.audit(rows), rows), repair.audit(rows)) == brute_audit(rows)
    for n in (7, 40, 300, 1000):
        rows = bytes(rng.choice([0, 1, 1, 1, 2, 2, 2, 3, 5, 6, 9, 10, 8]) for _ in range(n))
        assert (repair.audit_cost(repair.audit(rows), rows), repair.audit(rows)) == whole_audit(rows)


def test_blocks_meet_where_the_whole_search_crosses():
    rng = random.Random(4)
    for _ in range(60):
        rows = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 9, 10]) for _ in range(rng.randint(2, 30)))
        cuts = sorted({0, len(rows), *(rng.randint(1, len(rows)) for _ in range(4))})
        parts = [rows[a:b] for a, b in itertools.pairwise(cuts)]
        met = repair.borders([repair.matrix(x) for x in parts], 0, -1)
        assert "".join(repair.audit(x, s, e) for x, (s, e) in zip(parts, met)) == repair.audit(rows)


def plain_report(rows):
    """rows: conv_id, turn, role, text after damage. One dictionary per conversation, by the contract."""
    out, white = {}, " \t\n\x0b\x0c\r"
    mark = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    for conv in {r[0] for r in rows}:
        own = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2][:16], r[3][:64], mark(r)))
        seen, codes, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, _, role, text in own:
            bare = text.rstrip(white)
            fault = "blank" if not text.strip(white) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) | 4 * (fault in ("blank", "duplicate")) | 8 * (fault == "truncated"))
        turns = [r[1] for r in own if r[1] is not None]
        cost, letters = whole_audit(bytes(codes))
        said, state, at = [], 0, 0
        for x in letters:
            if x == "D":
                at += 1
                continue
            role = own[at][2] if x == "K" else "assistant" if state == 2 else "user"
            said.append(f"{role}:{'' if x == 'I' else own[at][3]}")
            state = {"s": 1, "u": 2, "a": 3}[role[:1]]
            at += x != "I"
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string"


def reported(spark, rows, **given):
    table = spark.createDataFrame(rows, TURNS).repartition(3).selectExpr("*", "1 AS n", "'x' AS part", "2 AS conv", "true AS none", "'y' AS codes")
    got = repair.conversation_report(repair.repair_blocks(table)).collect()
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_conversations(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["Yes.", "No", "", "  \n ", "What?", "so so", "Fine!  ", None, "é.", "a much longer text, " * 9 + "end."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire"]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 4, 7]), rng.choice(roles), rng.choice(texts)) for c in [*range(60), None] for _ in range(rng.randint(1, 9))]
    rows += [(100, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(5000)]  # many blocks, many partitions
    rows += [(101, 5, "user", "the same.")] * 3000 + [(101, 6, "assistant", "so.")]
    rows += [(102, 1, "user", "x" * 3_000_000 + "."), (102, 2, "assistant", "y" * 5_000_000), (102, 2, "assistant", "z.")]  # longer than a block
    assert reported(spark, rows) == plain_report(rows)
    monkeypatch.setattr(repair, "FEW", -1)  # without broadcasts
    assert reported(spark, rows[:400]) == plain_report(rows[:400])
    assert reported(spark, []) == {}


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Oh?"), (1, 2, "user", " "), (2, 0, "user", "Alone.")]
    got = repair.repaired_turns(repair.repair_blocks(spark.createDataFrame(rows, TURNS))).orderBy("conv_id", "part", "n", "place").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got] == [(1, "user", "Hi."), (1, "assistant", "Oh?")] and repair.audit(bytes([1])) == "D"


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in range(12) for t in range(12)] + [(None, None, None, None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, repair.damage(spark.createDataFrame(rows, TURNS)).collect()), key=key) == sorted(want, key=key) and {0, 1, 2, 3, 4} <= {zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, *_ in rows[:-1]}


# Vector codes


def plain_codes(vectors, parts=4, entries=256, rounds=4):
    """vectors: sorted (vec_id, label, integers). Exact k-means by part."""
    v = np.array([x for _, _, x in vectors], dtype=object)
    width = v.shape[1] // parts
    codes, errors, books = [], 0, []
    for k in range(parts):
        x = v[:, k * width : (k + 1) * width]
        book = [list(r) for r in x[:entries]]
        find = lambda: [min((sum((a - b) ** 2 for a, b in zip(r, e)), i) for i, e in enumerate(book)) for r in x]  # noqa: B023, E731
        for _ in range(rounds):
            at = [i for _, i in find()]
            for i in range(len(book)):
                own = [r for r, j in zip(x, at) if j == i]
                if own:
                    book[i] = [sum(c) // len(own) for c in zip(*own)]
        found = find()
        codes.append([i for _, i in found])
        errors = errors + np.array([d for d, _ in found], dtype=object)
        books.append(book)
    flat = ",".join(str(c) for b in books for e in b for c in e)
    return [bytes(c) for c in zip(*codes)], errors, hashlib.sha256(flat.encode()).hexdigest()


def test_vector_codes(spark):
    rng = np.random.default_rng(2)
    made = rng.normal(0, 0.3, (420, 8)).astype(np.float32)
    made[40:60] = made[0]  # ties
    rows = [(int(i), [float(x) for x in r], int(i) % 5 if i % 7 else None) for i, r in enumerate(made)]
    rows += [rows[3], rows[3], (None, rows[9][1], 1), (5, rows[10][1], 2)]
    bad = [(1000, None, 1), (1001, [0.0] * 7 + [None], 1), (-5, [float("nan")] * 8, 1), (1003, [float("inf")] + [0.0] * 7, None), (1004, [float("-inf")] + [0.0] * 7, None)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").repartition(3).selectExpr("*", "1 AS v", "'x' AS d", "2 AS code", "3 AS error", "4 AS of_label")
    got = vector_codes.compress_vectors(table).collect()
    ints = lambda e: [int(np.floor(1024 * float(np.float32(x)))) for x in e]
    kept = sorted(((i, label, ints(e)) for i, e, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    codes, errors, digest = plain_codes(kept)
    by_label = {}
    for (_, label, _), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    want = sorted(str((i, label, c, int(e), int(by_label[label]), digest)) for (i, label, _), c, e in zip(kept, codes, errors))
    assert sorted(str((r["vec_id"], r["label"], bytes(r["code"]), r["error"], r["label_error"], r["codebooks_sha256"])) for r in got) == want


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<double>, label string"
    few = spark.createDataFrame([(2, [0.5, -0.5, 1.0, 0.0], "a"), (1, [0.25, 0.0, 1.0, 0.0], None)], schema)
    got = {r["vec_id"]: r for r in vector_codes.compress_vectors(few).collect()}
    assert bytes(got[1]["code"]) == b"\0\0\0\0" and bytes(got[2]["code"]) == b"\1\1\0\0" and got[1]["error"] == got[2]["error"] == 0
    for rows in ([], [(1, None, "a")]):
        out = vector_codes.compress_vectors(spark.createDataFrame(rows, schema))
        assert out.count() == 0 and out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(spark.createDataFrame([(1, [1.0, 2.0], "a")], schema))
    with pytest.raises(Exception, match="components"):
        vector_codes.compress_vectors(spark.createDataFrame([(1, [1.0] * 4, "a"), (2, [1.0] * 8, "a")], schema), entries=1).collect()


def test_search_is_exact_and_pruned():
    rng = np.random.default_rng(5)
    entries = np.concatenate([rng.integers(-900, 900, (200, 16)), rng.integers(-900, 900, (20, 16)).repeat(2, 0)])
    x = np.concatenate([entries[rng.integers(0, 240, 300)] + rng.integers(-40, 40, (300, 16)), rng.integers(-9000, 9000, (50, 16)), entries[:5]])
    pivots = vector_codes.farthest(entries, 8)
    evaluated = []
    code, best = vector_codes.nearest(x, vector_codes.distances(x, pivots), entries, vector_codes.distances(pivots, entries), evaluated)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (best == every.min(1)).all() and (code == every.argmin(1)).all() and sum(evaluated) < 0.8 * every.size


# Web archives


PAGES = "page_id long, url string, html string"


def test_pages_round_trip(spark, tmp_path):
    long, short = "<p>é" * 60, "<p>short"
    rows = [(k, f"http://x/{k} a\nb", f"<html>{k}</html>" * 20) for k in range(40)] + [(50, None, None), (51, "http://x", ""), (None, "http://n", long), (7, "http://y", long), (60, None, long), (7, "http://y", long)]
    rows += [(61, "u", short), (62, "u", short), (63, "u", "w" * 2_000_000 + "\r\n\r\nWARC/1.1\r\n"), (64, "u", "w" * 2_000_000 + "\r\n\r\nWARC/1.1\r\n"), (None, "u", "n" * 100), (None, "u", "n" * 100)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3).selectExpr("*", "1 AS digest", "'x' AS payload", "2 AS first", "3 AS copies")
    first = {}
    for k, _, html in rows:
        if len((html or "").encode()) >= 100 and k is not None:
            first[html] = min(k, first.get(html, k))
    want = []
    for k, _, html in rows:
        raw = (html or "").encode()
        revisit = html in first and first[html] != k
        want.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None))
    for compression in ("gzip", "none"):
        at = str(tmp_path / compression)
        warc.write_pages(pages, at, compression=compression, fileBytes="3000")
        assert sorted(map(str, map(tuple, warc.read_pages(spark, at).collect()))) == sorted(map(str, want))
    assert sorted(map(str, map(tuple, warc.archive_round_trip(pages).collect()))) == sorted(map(str, want))
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    uris = {r["target_uri"] for r in warc.read_archives(spark, at, ["target_uri"]).collect()}
    assert "http://x/3%20a%0Ab" in uris and None in uris


def test_predicates_are_pushed_down_and_payloads_skipped(spark, tmp_path):
    rows = [(k, f"http://x/{k}", "".join(random.Random(k).choices("abcdefghij \n", k=300_000))) for k in range(6)] + [(10, "http://x/10", "".join(random.Random(0).choices("abcdefghij \n", k=300_000)))]
    for compression, most in (("gzip", 20_000), ("none", 10_000)):
        at = str(tmp_path / compression)
        warc.write_pages(spark.createDataFrame(rows, PAGES).repartition(2), at, compression=compression)
        found = warc.read_archives(spark, at).filter("record_type = 'revisit' AND target_uri LIKE 'http://x/1%' AND content_length > 0")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "record_type" not in [x for x in plan.splitlines() if "Filter" in x and "BatchScan" not in x][0]  # only the scan looks at it
        assert [(r["target_uri"], r["payload"], r["payload_length"]) for r in found.collect()] == [("http://x/10", None, 300_000)]
        with_payload, without = _decoded(at, ["payload"]), _decoded(at, ["record_type", "payload_length"])
        assert min(x for x in with_payload if x > 1000) > 290_000 and max(without) < most


def _decoded(at, columns):
    sizes = []
    for name, _ in warc.archive_files(at):
        with pafs.LocalFileSystem().open_input_file(name) as f:
            list(warc.scan(f, name, warc.Wanted(columns, []), sizes))
    return sizes


def test_archives_of_other_writers(spark, tmp_path):
    block = b"HTTP/1.0 200 OK\r\nX-A: 1\r\n continued\r\n\r\nbody"
    records = [
        warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:1>"), ("Content-Type", "application/warc-fields")], b"software: x\r\n"),
        warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:2>"), ("Content-Type", "application/http; msgtype=response")], block),
        warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:3>"), ("Content-Type", "text/plain")], b""),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))  # members that do not tell their length
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    (tmp_path / "c.txt").write_bytes(b"no archive")
    got = warc.read_archives(spark, str(tmp_path)).orderBy("file", "offset").collect()
    assert [(r["record_type"], bytes(r["payload"])) for r in got] == [("warcinfo", b"software: x\r\n"), ("response", b"body"), ("resource", b"")] * 2
    assert got[1]["http_headers"] == {"x-a": "1 continued"} and got[1]["record_id"] == "urn:2" and got[1]["payload_length"] == 4
    assert [r["record_id"] for r in warc.read_archives(spark, str(tmp_path / "b.warc"), ["record_id"]).filter("record_id IN ('urn:1', 'urn:3')").collect()] == ["urn:1", "urn:3"]
    (tmp_path / "d.warc").write_bytes(records[1][:-20])
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(spark, str(tmp_path / "d.warc"), ["payload"]).collect()


def test_only_committed_files_are_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "v", "two")], PAGES)
    at = str(tmp_path)
    warc.write_pages(pages, at)
    (tmp_path / "part-of-a-lost-attempt.warc").write_bytes(b"WARC/1.1\r\nhalf")
    assert warc.read_pages(spark, at).count() == 2
    warc.write_pages(pages, at)
    assert warc.read_pages(spark, at).count() == 4
    warc.page_records(pages.limit(1), "2024-01-01T00:00:00Z").write.format("warc").mode("overwrite").save(at)
    assert warc.read_pages(spark, at).count() == 1 and len([*tmp_path.glob("*.warc*")]) == 1


def test_a_member_may_begin_in_the_last_bytes_of_a_stretch(tmp_path, monkeypatch):
    block = b"HTTP/1.0 200 OK\r\n\r\n" + random.Random(1).randbytes(9000)
    one = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:1>"), ("Content-Type", "application/http")], block)
    for pack in (warc.gzip_member, gzip.compress, bytes):
        first = pack(one)
        (tmp_path / "a").write_bytes(first * 3)
        for left in (1, 2, 11, 12, 25):
            monkeypatch.setattr(warc, "READ_BYTES", len(first) + left)
            with pafs.LocalFileSystem().open_input_file(str(tmp_path / "a")) as f:
                got = list(warc.scan(f, "a", warc.Wanted(["offset", "payload"], [])))
            assert [r["offset"] for r in got] == [0, len(first), 2 * len(first)] and {r["payload"] for r in got} == {block[19:]}
