"""The pipeline's near-duplicate stage searches by the Gray-order tree and finds what a plain comparison finds."""

import numpy as np

from turnlens.llm import simhash


def test_near_goes_through_the_tree_and_loses_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (40, simhash.LANES), dtype=np.uint64)
    rows = np.repeat(base, 8, axis=0)
    for row in rows:
        for k in rng.integers(0, 64 * simhash.LANES, 45):
            row[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    n = rng.integers(3, 60, len(rows))
    asked = []
    within = simhash.GrayTree.within
    monkeypatch.setattr(simhash.GrayTree, "within", lambda self, q, bits: asked.append(len(q)) or within(self, q, bits))
    got = simhash.near(rows[:100], rows, n[:100], n, 0.8)
    assert asked == [100]
    bits = np.bitwise_count(rows[:100, None] ^ rows[None]).sum(axis=2)
    low, high = np.minimum(n[:100, None], n), np.maximum(n[:100, None], n)
    want = np.where((bits <= simhash.differing_bits(0.8) + 24 * (low < 6)) & (low >= 0.8 * high - 1e-9), bits, 1000)
    assert (got == want).all() and (got < 1000).sum() > 200
    assert simhash.near(rows[:0], rows, n[:0], n, 0.8).shape == (0, len(rows))
