"""Mutual information of two continuous sides against all distances in the plane, over several strips."""

import math
import random

import numpy as np
import pytest

from framevitals.operators.plane import Boxes, plane_information
from test_neighbours import psi


def plain(rows, k=3):
    rows = [(x, y) for x, y in rows if math.isfinite(x) and math.isfinite(y)]
    n = len(rows)
    if n < 2:
        return None
    x, y = np.array(rows).T
    ratio = 1.0
    if x.std() > 0 and y.std() > 0:
        ratio = x.std() / y.std()
        unit = 2.0 ** (math.floor(math.log2(ratio)) - 9)
        ratio = round(ratio / unit) * unit
    y = y * ratio
    wanted, total = min(k, n - 1), 0.0
    for i in range(n):
        d = np.maximum(abs(x - x[i]), abs(y - y[i]))
        r = np.sort(np.delete(d, i))[wanted - 1]
        for v in (x, y):
            m = int(((v > v[i] - r) & (v < v[i] + r)).sum()) if r > 0 else int((v == v[i]).sum())
            total += psi(m)
    return max(0.0, psi(n) + psi(wanted) - total / n)


def cases(seed):
    r = random.Random(seed)
    free = [(r.gauss(0, 1), r.gauss(5, 300)) for _ in range(400)]
    bound = [(x, x * x + r.gauss(0, 0.01)) for x in (r.uniform(-1, 1) for _ in range(400))]
    grid = [(float(r.randint(0, 6)), float(r.randint(0, 4))) for _ in range(300)]
    point = [(0.0, 0.0)] * 150 + [(r.random(), r.random()) for _ in range(300)]
    lines = [(0.0, r.random()) for _ in range(150)] + [(r.random(), 0.0) for _ in range(150)] + [(r.random(), r.random()) for _ in range(150)]
    far = [(r.random() * 1e-6, r.random()) for _ in range(200)] + [(1e6, 3.0), (-1e6, -0.0), (math.inf, 1.0), (1.0, math.nan)]
    constant = [(2.0, r.random()) for _ in range(100)]
    few = [(1.0, 2.0), (1.5, 9.0), (4.0, 0.5)]
    copies = [(-0.0, 1.0), (0.0, 1.0), (0.0, 1.0)]
    return [free, bound, grid, point, lines, far, constant, few, copies]


@pytest.mark.parametrize("seed,strips", [(1, None), (2, 40), (3, 1)])
def test_all_distances_in_the_plane(spark, seed, strips):
    sets = cases(seed)
    rows = [(f, x, y) for f, some in enumerate(sets) for x, y in some] + [(0, None, 1.0), (0, 1.0, None), (99, 1.0, 1.0)]
    got = {r["f"]: r["mi"] for r in plane_information(spark.createDataFrame(rows, "f int, x double, y double"), strips=strips).collect()}
    assert got == {f: pytest.approx(plain(some), abs=1e-9) for f, some in enumerate(sets)}


def test_empty(spark):
    assert plane_information(spark.createDataFrame([], "f int, x double, y double")).count() == 0


def test_leaves_hold_every_box_that_is_near():
    r = np.random.default_rng(5)
    low = r.random((1000, 2)) * [1, 100]
    high = low + r.random((1000, 2))
    tree, q = Boxes(low, high), r.random((50, 2)) * [1, 100]
    who, leaf = tree.leaves(q, np.full(50, 2.0))
    met = {(i, j) for i, lf in zip(who, leaf) for j in tree.item[lf]}
    d = np.maximum(np.maximum(low[None] - q[:, None], q[:, None] - high[None]), 0).max(axis=2)
    assert {(i, j) for i, j in zip(*np.nonzero(d < 2.0))} <= met
    assert sorted(tree.item[~tree.copy]) == list(range(1000))
