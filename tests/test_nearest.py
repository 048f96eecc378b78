"""Nearest clusters over a pair of tiles."""

import tracemalloc

import numpy as np
import pytest

from tidemark.operators import tiles


def units(rng, n):
    x = rng.normal(size=(n, 16))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("most", "same"), [(0.3, False), (0.3, True), (1.9, False), (1e-9, False)])
def test_nearest_is_that_of_all_distances(most, same):
    rng = np.random.default_rng(1)
    x = units(rng, 700)
    y = x if same else np.concatenate([units(rng, 500), x[:40], x[:40]])
    ids, others = np.arange(len(x)) * 2, np.arange(len(y)) * 2 + (0 if same else 1)
    d = 1 - x @ y.T
    d[ids[:, None] == others[None, :]] = np.inf
    want = [(int(i), int(others[k])) for i, r, k in zip(ids, d, d.argmin(1), strict=True) if r[k] < most]
    want += [] if same else [(int(i), int(ids[k])) for i, r, k in zip(others, d.T, d.T.argmin(1), strict=True) if r[k] < most]
    got = list(tiles._nearest(x, y, ids, others, most, not same))
    assert sorted((i, j) for i, _, j in got) == sorted(want) and all(far < most for _, far, _ in got)


def test_a_pair_of_tiles_is_never_a_whole_matrix():
    rng = np.random.default_rng(2)
    x, y, n = units(rng, 2048), units(rng, 2048), np.arange(2048)
    tracemalloc.start()
    list(tiles._nearest(x, y, n, n + 2048, 0.3, True))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2048 * 2048 * 8 / 2
