"""Verification of n-gram sets in slabs against all pairs in plain Python."""

import numpy as np
import pytest

from quadrat.llm import ngram_join


def _plain(sets, left, weights):
    own = [set(s.tolist()) for s in sets]
    links, linked = np.zeros(len(own), np.int64), set()
    for i, a in enumerate(own):
        for j, b in enumerate(own):
            if i != j and (left is None or left[i] != left[j]) and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += weights[j]
                linked.add((i, j))
    return links, linked


def _classes(number, pairs):
    of = list(range(number))
    for a, b in pairs:
        x, y = of[a], of[b]
        of = [x if c == y else c for c in of]
    return {frozenset(k for k in range(number) if of[k] == c) for c in of}


@pytest.mark.parametrize("blocks", ["one", "two", "left only", "right only"])
@pytest.mark.parametrize("items,rows", [(100, 7), (1_000_000, 256)])
def test_slabs_against_all_pairs(monkeypatch, blocks, items, rows):
    monkeypatch.setattr(ngram_join, "SLAB_ITEMS", items)
    monkeypatch.setattr(ngram_join, "SLAB_ROWS", rows)
    rng = np.random.default_rng(7)
    bases = rng.integers(-(2**63), 2**63 - 1, (3, 40))
    sets = []
    for k in range(40):
        kept = bases[k % 3][rng.random(40) > 0.12 * rng.random()]
        sets.append(np.concatenate([kept, rng.integers(-(2**63), 2**63 - 1, k % 5)]))
    sets += [np.array([5]), np.array([5]), np.array([6])]
    weights = rng.integers(1, 9, len(sets))
    left = {"one": None, "two": np.arange(len(sets)) % 2 == 0, "left only": np.ones(len(sets), bool), "right only": np.zeros(len(sets), bool)}[blocks]
    links, forest = ngram_join._verified(sets, left, weights, (4, 5))
    expected, linked = _plain(sets, left, weights)
    assert links.tolist() == expected.tolist()
    assert bool(linked) == (blocks in ("one", "two"))
    assert set(forest) <= linked
    assert _classes(len(sets), forest) == _classes(len(sets), linked)
