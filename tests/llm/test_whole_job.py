"""Operators on inputs on which a shortcut would lose rows."""

import random

import corpus_pipeline
from fernspark.llm import minhash, substring_dedup


def prose(rng, n):
    return [f"{rng.choice('bcdfgh')}{rng.randrange(10**6)}" for _ in range(n)]


def passages(spark, rows):
    """Per document the word places that its repeated passages cover."""
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string").repartition(3)
    out = {k: set() for k, _ in rows}
    for r in substring_dedup.repeated_passages(df).collect():
        out[r["doc_id"]].update(range(r["start"], r["end"]))
    return out


def test_passages_beside_own_words(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k, (size, gap) in enumerate([(52, 28), (60, 35), (64, 33)] * 8):
        a, b = prose(rng, size), prose(rng, size)
        rows += [(k, prose(rng, 20) + a + prose(rng, gap) + b + prose(rng, 20)), (100 + k, prose(rng, 30) + a + prose(rng, gap) + b + prose(rng, 10))]
        want[100 + k] = {*range(30, 30 + size), *range(30 + size + gap, 30 + 2 * size + gap)}
    got = passages(spark, rows)
    assert {k: v for k, v in got.items() if v} == want


def test_passages_with_a_word_changed_every_few(spark):
    """The share of 60-word passages found when every tenth or twelfth word is another one, and the words that are covered."""
    rng = random.Random(9)
    for gap in (10, 12):
        rows = []
        for k in range(60):
            a = prose(rng, 60)
            b = [x if n % gap != gap // 2 else prose(rng, 1)[0] for n, x in enumerate(a)]
            rows += [(k, prose(rng, 40) + a + prose(rng, 30)), (100 + k, prose(rng, 35) + b + prose(rng, 50))]
        got = passages(spark, rows)
        found = [got[100 + k] for k in range(60) if got[100 + k]]
        assert len(found) >= 54 and not any(got[k] for k in range(60))
        assert all(len(x & set(range(35, 95))) >= 48 and len(x) <= 66 for x in found)


def test_exact_runs_survive_any_alignment():
    import numpy as np

    a, b = np.arange(200), np.arange(1000, 1200)
    b[20:80], b[110:170] = a[10:70], a[110:170]
    got = substring_dedup.align(a, b, np.array([10, 110]), np.array([20, 110]), np.array([60, 60]))
    assert {(s[0], s[1], s[4]) for s in got} == {(10, 70, 60), (110, 170, 60)}


def test_a_passage_that_stands_twice(spark):
    rng = random.Random(2)
    a, c = prose(rng, 70), prose(rng, 90)
    rows = [(1, prose(rng, 20) + a + prose(rng, 20)), (2, prose(rng, 30) + a + prose(rng, 80) + a + prose(rng, 15)), (3, c + prose(rng, 9) + c + prose(rng, 9) + c)]
    rows += [(4, prose(rng, 11) + c + c + prose(rng, 60))]
    got = passages(spark, rows)
    assert got[1] == got[3] == set()
    assert got[2] == {*range(30, 100), *range(180, 250)} and got[4] == set(range(11, 191))


def test_two_large_families_of_versions_are_compared(spark):
    rng = random.Random(3)
    base = prose(rng, 304)
    other = base[:150] + prose(rng, 20) + base[170:]
    rows = [(1000 * v + k, " ".join(text + [f"own{v}x{k}"] * (k > 0))) for v, text in enumerate((base, other)) for k in range(61)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=40).collect()
    assert len(got) == 122 and {r["component_id"] for r in got} == {0}


def test_near_stage_drops_copies_of_four_fifths(spark):
    rng = random.Random(4)
    base = prose(rng, 504)
    rows = [(1, " ".join(base)), (2, " ".join(base[:200] + prose(rng, 45) + base[245:])), (3, " ".join(base[:200] + prose(rng, 60) + base[260:]))]
    got = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in got.collect()} == {1, 3}  # similarities 0.82 and 0.77


def test_estimates_are_cut_by_the_percentage_asked_for():
    import numpy as np
    import pyarrow as pa

    a, b = np.arange(48), np.concatenate([np.arange(0, 48, 2), np.arange(100, 124)])  # 24 of 48: an estimate of one half
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), pa.array([a.tolist()]), pa.array([b.tolist()])], names=["a", "b", "sa", "sb"])
    kept = {p: sum(x.num_rows for x in minhash._likely(iter([batch]), p)) for p in (80, 85, 90)}
    assert kept == {80: 1, 85: 1, 90: 0}


def links(sets, percent):
    """Components by all pairs: smallest index per index."""
    values = {}
    for k, s in enumerate(sets):
        for v in s:
            values.setdefault(v, []).append(k)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = 0
    for i in range(len(sets)):
        common = {}
        for v in sets[i]:
            for j in values[v]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                n += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(sets))], n


def shingled(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def components_are_those_of_all_pairs(spark, texts, **how):
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **how).collect()
    want, n = links([shingled(w) for w in texts], 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))
    return n


def test_documents_of_shared_passages(spark):
    """Documents put together of a few passages that very many share, and near copies of some: no link is lost."""
    for seed, (n, passages, size) in enumerate(((300, 25, 500), (450, 30, 1000))):
        rng = random.Random(seed)
        parts = [prose(rng, size) for _ in range(passages)]
        texts = [sum((parts[p] for p in rng.sample(range(passages), 3)), []) for _ in range(n)]
        for _ in range(n // 5):
            w = list(texts[rng.randrange(n)])
            at = rng.randrange(len(w) - 100)
            w[at : at + len(w) // 20] = prose(rng, len(w) // 20)
            texts.append(w)
        assert components_are_those_of_all_pairs(spark, texts) >= n // 5


def test_large_families_with_and_without_a_typical_member(spark):
    """Families of more classes than a block: versions of one text, a chain of sliding windows, and rings of edits around a text."""
    rng = random.Random(7)
    base, long = prose(rng, 300), prose(rng, 900)
    texts = [base]
    for k in range(150):  # versions, some of which only others link
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(300)] = f"edit{k}"
        texts.append(w)
    texts += [long[k : k + 300] for k in range(0, 600, 4)]
    ring = list(base)
    ring[:30] = prose(rng, 30)
    for k in range(60):  # a second text too far from the first one, with versions of its own between them
        w = list(ring)
        w[: rng.randrange(30)] = base[: rng.randrange(30)]
        w[200 + k] = f"ring{k}"
        texts.append(w)
    rng.shuffle(texts)
    for how in ({"block": 16}, {"block": 40, "list_limit": 5}, {}):
        assert components_are_those_of_all_pairs(spark, texts, **how) > 1000
