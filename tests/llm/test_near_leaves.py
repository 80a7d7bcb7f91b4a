"""Leaves of the near-duplicate search: links join up what is similar, whatever the size of a step."""

import numpy as np
import pytest

from labspark.llm import simhash


def _leaf(sets, distance=64):
    n = len(sets)
    rows = {"print": np.zeros(n, np.uint64), "second": np.zeros(n, np.uint64), "size": np.array([len(s) for s in sets]), "label": np.arange(n), "block": np.zeros(n, np.int64)}
    return simhash.Leaf(rows, np.arange(n), np.ones(n, bool), distance, 128, 0.8)


def _groups(n, links):
    label = list(range(n))
    for a, b in links:
        label = [label[b] if x == label[a] else x for x in label]
    return {frozenset(i for i in range(n) if label[i] == g) for g in set(label)}


@pytest.mark.parametrize("wide", [False, True])
def test_links_join_up_all_similar_sets(wide, monkeypatch):
    rng, sets = np.random.default_rng(3), []
    for _ in range(40):
        base = rng.choice(1 << 40, 60, replace=False)
        sets += [np.sort(np.concatenate((base[: 60 - k], rng.choice(1 << 40, k)))).astype(np.uint64) for k in (0, 2, 4, 20)]
    if wide:  # the sets' bits take too much memory
        monkeypatch.setattr(simhash, "_bitmaps", lambda sets: np.zeros((0, 1), np.uint64))
    want = [(i, j) for i in range(len(sets)) for j in range(i) if (c := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - c)]
    assert want and _groups(len(sets), simhash.joined_up(_leaf(sets), sets, False)) == _groups(len(sets), want)


def test_sets_without_a_common_value():
    sets = [np.array([i], np.uint64) for i in range(5)]
    assert list(simhash.joined_up(_leaf(sets), sets, False)) == []
