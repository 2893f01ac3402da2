"""Operators against brute force, on rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fernspark.llm import chat, exact_dedup, lm_scoring, minhash, packing, quality_classifier, quality_rules, sampling, sharding, substring_dedup

WHITE = "[\x20\x09-\x0d]+"


def split(text):
    return [w for w in re.split(WHITE, text or "") if w]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = split(low(text))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_exact_dedup(docs, corpus, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in corpus:
        groups[re.sub(WHITE, " ", text or "")].append(doc_id)
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert Counter(map(tuple, got)) == Counter(want)
    assert exact_dedup.exact_dedup(empty).collect() == []


@pytest.mark.parametrize("limit,block", [(48, 1500), (2, 2)])
def test_near_duplicates(docs, corpus, empty, limit, block):
    got = minhash.near_duplicates(docs, list_limit=limit, block=block).collect()
    sets = [(doc_id, shingles(text)) for doc_id, text, *_ in corpus]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    want = []
    for k, (doc_id, s) in enumerate(sets):
        ids = [i for n, (i, t) in enumerate(sets) if root(n) == root(k) and i is not None] if s else [doc_id]
        component = min(ids, default=None) if s else doc_id
        want.append((doc_id, len(s), component, doc_id == component))
    assert Counter(map(tuple, got)) == Counter(want)
    assert minhash.near_duplicates(empty).collect() == []


def test_near_duplicates_of_a_large_family(spark):
    """Frequent values, hubs, several blocks: the same components as all pairs give."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    passage = [rng.choice(words) for _ in range(60)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for k in range(160):
        if k % 2:
            w = [rng.choice(words) for _ in range(60)] + passage
        else:
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), list_limit=10, block=25).collect()}
    sets = {k: shingles(t) for k, t in rows}
    comp = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if comp[b] < comp[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a], changed = comp[b], True
    assert got == comp


def test_quality_rules_counts(docs, corpus, empty):
    got = Counter(map(tuple, quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()))
    want = Counter()
    for doc_id, text, *_ in corpus:
        w = split(text)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if split(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[(doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)] += 1
    assert got == want
    assert quality_rules.quality_rules(empty).collect() == []


def test_common_lines_are_removed_and_depleted_documents_rejected(spark, words):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    menu, licence, footer = "Home About Contact 12", prose(60), "All rights reserved by the people of this site"
    rows = [(k, f"{menu}\n{licence}\n{prose(rng.randint(20, 90))}\n{footer.upper()}", "host") for k in range(60)]
    copy = prose(30) + "\n" + prose(35)
    rows += [(100 + k, copy, "host") for k in range(40)]  # exact copies are one document
    rows += [(200, "\n".join([menu.replace("12", "34")] * 10 + [prose(45)]), "host"), (201, f"{menu}\n{prose(60)}", "other"), (202, f"{menu}\n{prose(60)}", None), (203, None, "host")]
    rows += [(300 + k, f"{footer}\n{prose(55)}", None) for k in range(26)] + [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = quality_rules.quality_rules(df, max_documents=25)
    digits = lambda line: re.sub("[0-9]", "0", " ".join(split(low(line))))
    holders = defaultdict(set)
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            holders[host, digits(line)].add(text)
    want = Counter()
    for doc_id, text, host in rows:
        w = split(text)
        lost = sum(len(split(line)) for line in (text or "").split("\n") if len(holders[host, digits(line)]) > 25)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        failed = len(w) < 50 or 100 * len({k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}) > 50 * len(w)
        want[doc_id, lost, failed, not failed and 2 * lost <= len(w)] += 1
    assert Counter((r["doc_id"], r["removed_words"], r["base_failed"], r["kept"]) for r in out.collect()) == want
    by_id = {k[0]: k for k in want}
    assert {by_id[k][3] for k in range(60)} == {True, False} and by_id[100][1] == 0 and by_id[201][1] == by_id[202][1] == 0 and by_id[300][1] == 9
    cleaned = df.join(out.select("doc_id", "removed_lines").dropDuplicates(["doc_id"]), "doc_id").withColumn("clean", quality_rules.clean_text(F.col("text"), F.col("removed_lines")))
    texts = {r["doc_id"]: (r["text"], r["clean"]) for r in cleaned.collect()}
    assert texts[0][1] == texts[0][0].split("\n")[2] and texts[100][1] == texts[100][0] and texts[203][1] is None


@pytest.mark.parametrize("vocabulary", [0, 5, 8192])
def test_lm_scores_match_a_plain_model(spark, docs, corpus, empty, vocabulary):
    import math

    from fernspark.llm._kernels import text_buffers, words as split_words
    import pyarrow as pa

    target = [5, 7, 12, 26, 99]
    got = lm_scoring.score_documents(docs, spark.createDataFrame([(i,) for i in [*target, 5]] + [(None,)], "doc_id long"), vocabulary).collect()
    rows = [(doc_id, split(low(text))) for doc_id, text, *_ in corpus]
    every = Counter(w for _, ws in rows for w in ws)
    # Ties at the end of the vocabulary go by hash: take the words that the operator takes.
    known = lm_scoring.frequent_words(docs.select("text"), vocabulary).tolist() if vocabulary else []
    import numpy as np

    from fernspark.llm._kernels import run_hashes

    w = split_words(*text_buffers(pa.array(list(every))))
    hashes = dict(zip(every, run_hashes(w.data, w.starts, w.ends, 1).astype(np.int64).tolist()))
    taken = {x for x in every if hashes[x] in known}
    assert len(taken) == min(vocabulary, len(every)) and (not taken or min(every[x] for x in taken) >= max((every[x] for x in every if x not in taken), default=0))

    def token(x):
        b = x.encode()
        return x if x in taken else (sum(len(b) >= n for n in (4, 7, 11)), any(c in b"0123456789" for c in b), any(c < 128 and not chr(c).isalnum() for c in b), any(c >= 128 for c in b))

    coded = [(doc_id, [token(x) for x in ws]) for doc_id, ws in rows]
    size = len(taken) + 1 + lm_scoring.SHAPES

    pairs = lambda ws: Counter(zip([None, *ws], ws))
    of = {}
    for name, member in (("t", lambda i: i in target), ("b", lambda i: True)):
        counts = sum((pairs(ws) for i, ws in coded if member(i)), Counter())
        u = Counter(y for (_, y), n in counts.items() for _ in range(n))
        for k, (i, ws) in enumerate(coded):
            if ws:
                mine = pairs(ws)
                own = mine if member(i) else Counter()
                # Its own counts are taken away where it is part of the corpus.
                total = sum(u.values()) - sum(own.values())
                rest, words_left = counts - own, u - Counter(y for (_, y), n in own.items() for _ in range(n))
                history, types, value = Counter(), Counter(), 0.0
                for (x, _), n in rest.items():
                    history[x] += n
                    types[x] += 1
                for (x, y), n in mine.items():
                    p = (words_left[y] + 1) / (total + size)
                    if history[x] + types[x]:
                        p = (rest[x, y] + types[x] * p) / (history[x] + types[x])
                    value -= n * math.log(p)
                of[name, k] = value / len(ws)
    want = Counter((i, len(ws), *((round(of["t", k], 6), round(of["b", k], 6)) if ws else (None, None))) for k, (i, ws) in enumerate(coded))
    assert Counter((r["doc_id"], r["n_tokens"], *((round(r["target_loss"], 6), round(r["background_loss"], 6)) if r["n_tokens"] else (r["target_loss"], r["background_loss"]))) for r in got) == want
    assert all(r["score"] is None if not r["n_tokens"] else abs(r["score"] - r["target_loss"] + r["background_loss"]) < 1e-8 for r in got)
    assert lm_scoring.score_documents(empty, spark.createDataFrame([], "doc_id long")).collect() == []


def test_sampled_segmentations(docs, corpus, empty):
    got = sampling.sample_encodings(docs, samples=3).collect()
    by_doc = defaultdict(list)
    for r in got:
        assert r["round_trip"]
        by_doc[r["doc_id"]].append(r)
    texts = defaultdict(set)
    for doc_id, text, *_ in corpus:
        texts[doc_id].add(text or "")
    pieces = sampling._lattices(sampling._path(None)).vocabulary.pieces
    import numpy as np

    for doc_id, rows in by_doc.items():
        for r in rows:
            assert sampling.decode_ids(np.array(r["ids"], int), pieces).decode() in texts[doc_id]
        if doc_id == 5:
            assert len({tuple(r["ids"]) for r in rows}) == 3 and all(r["log_inclusion"] <= 0 for r in rows)
            values = [r["perturbed"] for r in sorted(rows, key=lambda r: r["rank"])]
            assert values == sorted(values, reverse=True)
    assert len(by_doc[11]) == 1 and by_doc[11][0]["ids"] == [] and by_doc[11][0]["log_inclusion"] == 0
    again = sampling.sample_encodings(docs.repartition(5), samples=3).collect()
    key = lambda rows: Counter((r["doc_id"], r["rank"], tuple(r["ids"]), round(r["perturbed"], 6)) for r in rows)
    assert key(again) == key(got)
    assert sampling.sample_encodings(empty).collect() == []


def test_samples_have_the_right_distribution():
    """Frequencies of the first and of ordered pairs of samples against exact probabilities of a short text."""
    import numpy as np
    import pyarrow as pa

    from fernspark.llm._kernels import mix64, text_buffers

    lattices = sampling._lattices(sampling._path(None))
    v, text, n = lattices.vocabulary, b" the in", 20000
    known = {v.pieces[i]: v.weight[i] for i in range(len(v.pieces)) if v.weight[i] > -np.inf}
    ids = {v.pieces[i]: i for i in range(len(v.pieces)) if v.weight[i] > -np.inf}

    def paths(k):
        if k == len(text):
            yield (), 0.0
        for e in range(k + 1, len(text) + 1):
            if text[k:e] in known:
                yield from (((ids[text[k:e]], *rest), known[text[k:e]] + w) for rest, w in paths(e))

    every = list(paths(0))
    z = np.logaddexp.reduce([w for _, w in every])
    p = {s: float(np.exp(w - z)) for s, w in every}
    s = sampling.Sampler(lattices, *text_buffers(pa.array(["the in"] * n)), mix64(np.arange(n).astype(np.uint64)))
    found, kappa = s.run(2)
    drawn = []
    for path in found:
        flat, counts = s.ids(path)
        at = np.concatenate([[0], np.cumsum(counts)])
        drawn.append([tuple(flat[a:b].tolist()) for a, b in zip(at, at[1:])])
    first, pair = Counter(drawn[0]), Counter(zip(*drawn))
    assert max(abs(first[k] / n - p[k]) for k in p) < 0.015
    assert max(abs(pair[a, b] / n - p[a] * p[b] / (1 - p[a])) for a in p for b in p if a != b) < 0.015
    assert all(a != b for a, b in zip(*drawn)) and (kappa < found[1].value).all()
    # Weighted by one over its inclusion probability, each segmentation counts once on average.
    for path in p:
        weight = [1 / -np.expm1(-np.exp(np.log(p[path]) - kappa[k])) for k in range(n) if path in (drawn[0][k], drawn[1][k])]
        assert abs(sum(weight) / n - 1) < 0.25 or p[path] < 0.01


def test_very_long_words_are_sampled_like_others(monkeypatch):
    """A word beyond LONG_WORD gives the same samples as when all words are worked on together, and round-trips."""
    import numpy as np
    import pyarrow as pa

    from fernspark.llm._kernels import mix64, text_buffers

    rng = random.Random(4)
    texts = ["".join(rng.choice("theinandé中") for _ in range(n)) for n in (5, 700, 3000)] + ["a b " + "the" * 400, ""]
    drawn = []
    for limit in (64, 1 << 30):
        monkeypatch.setattr(sampling, "LONG_WORD", limit)
        lattices = sampling._lattices(sampling._path(None))
        lattices.clear()
        s = sampling.Sampler(lattices, *text_buffers(pa.array(texts)), mix64(np.arange(len(texts)).astype(np.uint64)))
        found, kappa = s.run(2)
        drawn.append([[x.tolist() for x in s.ids(path)] + [np.round(path.value, 4).tolist()] for path in found] + [np.round(kappa, 4).tolist()])
    assert drawn[0] == drawn[1]


def test_encode_and_decode(docs, corpus):
    out = sampling.decode(sampling.encode(docs)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((i, t or "") for i, t, *_ in corpus)


def test_repeated_passages(docs, corpus, empty):
    got = substring_dedup.repeated_passages(docs).collect()
    spans = defaultdict(set)
    for r in got:
        spans[r["doc_id"]].update(range(r["start"], r["end"]))
        assert all(s < r["doc_id"] for s in r["sources"])
    first, width = {}, 51
    for doc_id, text in sorted({(i, t or "") for i, t, *_ in corpus if i is not None}):
        w = split(low(text))
        for k in range(len(w) - width + 1):
            if first.setdefault(tuple(w[k : k + width]), doc_id) != doc_id:
                assert spans[doc_id] >= set(range(k, k + width)), (doc_id, k)
    assert 3 not in spans and 9 not in spans  # unlike documents stay
    assert substring_dedup.repeated_passages(empty).collect() == []


def test_cutting_passages(spark, words):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, a, b, c, d = prose(70), prose(50), prose(50), prose(30), prose(30)
    fuzzy = shared.split()
    fuzzy[30:32] = ["other"]
    rows = [(1, f"{a} {shared}", 0), (2, f"{b}\n{shared}\n{c}", 0), (3, shared, 0), (4, f"{d} {' '.join(fuzzy)}", 0), (5, "", 0), (6, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in substring_dedup.cut_spans(df, substring_dedup.repeated_passages(df)).collect()}
    assert set(got) == {1, 2, 4, 5, 6} and got[1]["text"] == rows[0][1]
    assert got[2]["text"] == f"{b}\n{c}" and got[2]["n_chars"] == len(b) + 1 + len(c)
    assert got[4]["text"].split() == d.split()


def test_fenwick_chains():
    import numpy as np

    one = substring_dedup.best_chains(np.array([0, 30, 20, 60]), np.array([0, 32, 500, 62]), np.array([20, 20, 10, 5]))
    assert sorted(map(tuple, one)) == [(0, 1, 3), (2,)]


def test_classifier_learns_and_is_blind_to_held_out_labels(spark, words, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        good = k % 3 > 0
        n = rng.randint(20, 80)
        text = " ".join(rng.choice(words) for _ in range(n)) if good else " ".join(rng.choice(words).upper() + "!!" for _ in range(n))
        rows.append((k, text, "en"))
        labels.append((k, int(good)))
    rows += [(1000, "", None), (1001, None, None), (None, "a b c", None), (0, rows[0][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_classifier.classify(df, known).withColumn("held", quality_classifier.fold() == 2).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    truth = dict(labels)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got if r["held"] and r["doc_id"] in truth) >= 0.98 * sum(r["held"] and r["doc_id"] in truth for r in got)
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels], "doc_id long, quality int")
    other = {r["doc_id"]: r["score"] for r in quality_classifier.classify(df, flipped).collect()}
    assert all(other[r["doc_id"]] == r["score"] for r in got)
    assert {r["score"] for r in quality_classifier.classify(df, known.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(empty, known).collect() == []


def test_ridge_weights_solve_the_normal_equations(spark, words):
    import numpy as np
    import pyarrow as pa

    from fernspark.llm._kernels import text_buffers

    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + "!" * (k % 3)) for k in range(200)]
    labels = [(k, int(k % 3 == 0)) for k in range(0, 200, 2)] + [(4, 1), (6, 5), (None, 1), (999, 1)]
    model = quality_classifier.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int"), features=20)
    known = {}
    for k, y in labels:
        if y in (0, 1) and k is not None:
            known[k] = max(y, known.get(k, 0))
    train = [(t, known[k]) for k, t in rows if k in known and zlib.crc32(str(k).encode()) % 4 < 2]
    stats = quality_classifier.statistics(*text_buffers(pa.array([t for t, _ in train])))
    assert np.allclose(model.mean, stats.mean(0), rtol=1e-5, atol=1e-9)
    z, y = model.project(stats), np.array([y for _, y in train], float)
    penalty = np.full(z.shape[1], quality_classifier.RIDGE)
    penalty[0] = 1e-6
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y))


def test_isotonic():
    import numpy as np

    assert quality_classifier.pool_adjacent(np.array([0.0, 3, 1, 4]), np.array([4.0, 4, 4, 4])).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_packing(docs, corpus, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(docs, window=64).collect()
    windows, texts = defaultdict(list), Counter()
    for p in pieces:
        assert p["length"] == len(p["ids"]) > 0
        windows[p["sequence_id"]].append(p)
    for parts in windows.values():
        parts.sort(key=lambda p: p["offset"])
        total = sum(p["length"] for p in parts)
        assert [p["offset"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))] and (total == 64 or total & (total - 1) == 0 and total < 64)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    want = defaultdict(Counter)
    for doc_id, text, *_ in corpus:
        want[doc_id][tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    for doc_id, parts in by_doc.items():
        held = want[doc_id]
        assert sum(p["length"] for p in parts) == sum(len(ids) * n for ids, n in held.items())
        if len(held) == 1:
            (ids, _), = held.items()
            assert all(tuple(p["ids"]) == ids[p["start"] : p["start"] + p["length"]] and p["doc_tokens"] == len(ids) for p in parts)
            covered = Counter(k for p in parts for k in range(p["start"], p["start"] + p["length"]))
            assert set(covered.values()) == {sum(held.values())}
    crc = {(r["doc_id"], r["sequence_id"], r["offset"]): r["ids_crc32"] for r in packing.piece_digests(packing.pack(docs, window=64)).collect()}
    assert len(crc) == len(pieces) and packing.pack(empty).collect() == []


def test_word_encoder_equals_the_library():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from fernspark.llm._kernels import text_buffers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder, rng = Tokenizer.from_file(path), packing.WordEncoder(path), random.Random(8)
    parts = ["a", "B", "é", "É", "×", "ß", "Ÿ", "1", "!", "'", "'s", "'RE", "<", "|>", "<|endoftext|>", "—", "́", " ", "\x1f", "\x85", "中", "İ", "σς", "\t", "\n", " ", "🙂", "_", "Å", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    ids, at = encoder.encode(*text_buffers(pa.array(texts)))
    for k, x in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == x.ids, texts[k]


def test_sum_of_squares_places_at_the_cheapest_level():
    import numpy as np

    p = packing.Packer(10)
    for size in (6, 6, 3):
        assert [*p.place(((0, 9), 0, np.zeros(size, np.uint32)))] == []
    # 3 could open a window (one more level with one window) or join a 6: going from counts {6: 2} to {6: 1, 9: 1} lowers the sum.
    assert p.counts.tolist() == [0, 0, 0, 0, 0, 0, 1, 0, 0, 1]


def test_packing_places_nearly_all_tokens_by_its_rule():
    """Open windows are bounded, every token is in one window, and few are left for the end."""
    import numpy as np

    rng, p, full, total = np.random.default_rng(1), packing.Packer(2048, 32), [], 0
    for k in range(1000):
        ids = np.arange(rng.integers(1, 2048), dtype=np.uint32)
        total += len(ids)
        full += p.place(((k, len(ids)), 0, ids))
        assert p.held == p.counts.sum() == sum(map(len, p.open)) <= 32
    left = [x for w in p.rest() for x in w]
    assert all(sum(len(x[2]) for x in w) == 2048 for w in full)
    assert sum(len(x[2]) for x in left) < 0.06 * total
    seen = Counter()
    for (doc, n), start, ids in [x for w in full for x in w] + left:
        assert ids.tolist() == list(range(start, start + len(ids)))
        seen[doc, n] += len(ids)
    assert all(n == held for (_, n), held in seen.items()) and sum(seen.values()) == total


def test_shards(spark, docs, corpus, empty):
    got = sharding.shard_documents(docs, 7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard_documents(empty, 7).collect() == []
    few = sharding.shard_documents(docs.limit(3), 7).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]
    fine = sharding.hilbert_shards(docs.selectExpr("doc_id", "source", "lang", "n_chars AS __size"), 5, rows_per_range=2).collect()
    assert len({(r["shard"], r["slot"]) for r in fine}) == len(corpus)
    order = [r["__curve"] for r in sorted(fine, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_written_shards_hold_their_rows_in_order(spark, docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    given = docs.selectExpr("doc_id", "source", "lang", "n_chars AS __size", "'own' AS shard", "0 AS slot")
    sharded = sharding.hilbert_shards(given, 3, rows_per_range=5)
    assert sharded.columns.count("shard") == sharded.columns.count("slot") == 1
    sharding.write_shards(sharded, str(tmp_path / "s"), 7)
    files = [pq.read_table(f, columns=["slot"])["slot"].to_pylist() for f in glob.glob(f"{tmp_path}/s/shard=*/*.parquet")]
    assert len(files) > 3 and all(f == list(range(f[0], f[0] + len(f))) for f in files)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r["shard"], r["slot"]) for r in back.collect()) == Counter((r["shard"], r["slot"]) for r in sharded.collect())


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 3), (3, 2)):
        order = sharding.hilbert_order(dims, bits)
        side = 1 << bits
        cells = sorted(range(len(order)), key=order.__getitem__)
        assert sorted(order) == list(range(side**dims))
        place = lambda c: [(c // side**k) % side for k in range(dims)]
        assert all(sum(abs(a - b) for a, b in zip(place(x), place(y))) == 1 for x, y in zip(cells, cells[1:]))


def test_chats(spark):
    rng = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>", "assistant\n", "<\\|", "<\\\\|", "\\", "\n", "hi ", "é", "<|", ""]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "odd\nrole\\n", None]), rng.choice([text, None]), 1))
    rows += [(None, 0, "user", "x", 1), (None, 1, "assistant", "y", 1), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    made = chat.format_chats(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(made).collect()}
    full = {r["conv_id"]: r["formatted"] for r in made.collect()}
    convs = defaultdict(list)
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        convs[conv].append((role or "", text or ""))
    for conv, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[conv] == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(full[conv]))
        assert full[conv].count("<|im_start|>") == len(turns) == full[conv].count("<|im_end|>")
    assert chat.read_back(chat.format_chats(df.limit(0))).collect() == []
