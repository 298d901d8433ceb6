"""Nearest points by cells against all distances."""

import numpy as np
import pytest

from furrow.operators.neighbours import Cells


@pytest.mark.parametrize("shape", ["cloud", "line", "clusters", "ties", "one", "same"])
@pytest.mark.parametrize("k", [1, 5, 64])
def test_nearest_are_those_of_all_distances(shape, k):
    r = np.random.default_rng(0)
    p = {"cloud": r.uniform(0, 100, (500, 2)), "line": np.c_[r.uniform(0, 1000, 300), np.zeros(300)], "clusters": np.concatenate([r.normal(0, 0.01, (200, 2)), r.normal(500, 5, (200, 2))]), "ties": np.stack(np.meshgrid(np.arange(20.0), np.arange(20.0)), -1).reshape(-1, 2), "one": np.array([[3.0, 4.0]]), "same": np.ones((80, 2))}[shape]
    q = np.concatenate([r.uniform(-50, 600, (200, 2)), p[:50], r.uniform(0, 20, (100, 2)).round()])
    d2, i = Cells(p[:, 0], p[:, 1], k).nearest(q[:, 0], q[:, 1], k)
    every = (p[:, 0] - q[:, :1]) ** 2 + (p[:, 1] - q[:, 1:]) ** 2
    want = np.argsort(every, axis=1, kind="stable")[:, :k]
    assert (i == want).all() and (d2 == np.take_along_axis(every, want, axis=1)).all()


def test_nothing_is_near_nothing():
    assert Cells(np.zeros(0), np.zeros(0)).nearest(np.zeros(3), np.zeros(3), 4)[0].shape == (3, 0)
