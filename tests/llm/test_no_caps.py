"""Nothing is lost to short prefixes, a limit on open windows, or narrow keys."""

import random

import numpy as np
import pytest

from fernspark.llm import lm_scoring, minhash, packing


def supersets(bases, each, size, more, twins=False):
    """Texts whose sets have `size` shingles in common with their base's and `more` of their own, which with `twins` one other text has too."""
    rng, rows, words = random.Random(bases * each), [], iter(range(10**9))
    fresh = lambda n: [f"w{next(words)}" for _ in range(n)]
    for b in range(bases):
        core = fresh(size + 4)
        rows.append((b, " ".join(core), b))
        tail: list[str] = []
        for k in range(each):
            if not (twins and k % 2):
                tail = fresh(more)
            cut = rng.choice([0, 1]) if not twins else 0
            text = tail + core if cut else core + tail
            rows.append((1000 + b * each * 2 + k, " ".join(text), b))
    return rows


@pytest.mark.parametrize("percent,bases,each,more,twins,given", [(85, 5, 300, 70, False, {}), (85, 2, 300, 70, True, {}), (85, 1, 1000, 70, False, dict(block=64)), (80, 2, 400, 99, False, {}), (80, 2, 120, 99, False, dict(list_limit=3, block=16))])
def test_supersets_of_one_base_are_linked_with_it(spark, percent, bases, each, more, twins, given):
    rows = supersets(bases, each, 400, more, twins)
    assert 100 * 400 >= percent * (400 + more)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, percent=percent, **given).collect()}
    assert got == {i: b for i, _, b in rows}


def test_prefixes_of_sets_that_share_enough_meet():
    rng = random.Random(1)
    for percent in (80, 85, 95):
        for _ in range(400):
            a, b = rng.randint(1, minhash.K), rng.randint(1, minhash.K)
            need = max(1, int(np.ceil((percent / 100 - minhash.MARGIN) * max(a, b) - 1e-9)))
            if need > min(a, b):
                continue
            shared = set(rng.sample(range(1000), need))
            x, y = (sorted(shared | set(rng.sample(range(1000 + 1000 * k, 2000 + 1000 * k), n - need)), key=lambda v: hash((v, percent))) for k, n in ((0, a), (1, b)))
            assert set(x[: minhash.prefix_length(len(x), percent)]) & set(y[: minhash.prefix_length(len(y), percent)])


def test_squared_counts_decide_where_a_piece_goes():
    rng, packer, crowded, held = np.random.default_rng(0), packing.Packer(), 0, []
    pieces = 0
    for k in range(6000):
        size = int(np.clip(rng.lognormal(5.2, 0.9), 1, packing.WINDOW - 1))
        crowded += packer.counts[1:].max() > 1
        for window in packer.place((k, 0, np.zeros(size, np.uint32))):
            pieces += len(window)
        held.append(packer.held)
        assert (packer.counts[1:].sum(), packer.counts.min()) == (packer.held, 0) or packer.counts.min() == 0
    assert crowded > 0.1 * 6000  # levels that hold several windows, which the rule weighs
    assert pieces + sum(len(w) for level in packer.open for w in level) == 6000  # none was cut
    assert max(held) < packing.OPEN_WINDOWS / 4


def test_scores_with_a_large_vocabulary_are_finite(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(f"v{rng.randrange(60_000)}" for _ in range(600))) for k in range(240)], "doc_id long, text string")
    got = lm_scoring.score_documents(docs, docs.filter("doc_id % 3 = 0").select("doc_id"), vocabulary=60_000).collect()
    assert len(got) == 240 and all(np.isfinite([r["score"], r["target_loss"], r["background_loss"]]).all() for r in got)
