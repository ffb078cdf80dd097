import random
from collections import Counter

import numpy as np

from tessera.llm import near_dedup
from tests.llm.test_near_dedup import brute, edited, run, words


def test_what_leaders_leave_is_done_in_one_round(spark, monkeypatch):
    """Many copies too far from their original, and a long text in overlapping windows, some of which are missing."""
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "LATER", 64)  # so that groups have several blocks
    made = Counter()
    written = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name: made.update([name]) or written(df, name))
    r = random.Random(11)
    base = words(r, 150)
    texts = [" ".join(edited(r, base, r.randint(3, 7))) for _ in range(250)]
    long = words(r, 1700)
    texts += [" ".join(long[4 * k : 4 * k + 60]) for k in range(400) if k % 7]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows, 4)
    assert len({c for _, c in want.values()}) > 80
    assert run(spark, rows) == want
    assert made["verified"] == 1 and sum(made.values()) < 80


def test_sizes_of_intersections():
    r = np.random.default_rng(3)
    often, seldom = np.arange(60), np.arange(100, 40_000)
    made = lambda n: [np.unique(np.concatenate([r.choice(often, r.integers(1, 50)), r.choice(seldom, r.integers(0, 300))])).astype(np.uint64) for _ in range(n)]
    for n, m in ((1, 1), (40, 70)):
        a, b = made(n), made(m)
        assert near_dedup.intersections(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
