"""Nearest-neighbour mutual information against all distances, over several ranges of the sorted points."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framevitals.operators.neighbours import digamma, neighbour_information


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain(rows, k=3):
    sizes = Counter(c for c, _ in rows)
    rows = [(c, x) for c, x in rows if sizes[c] > 1]
    total = 0.0
    for i, (c, x) in enumerate(rows):
        near = sorted(abs(x - y) for j, (d, y) in enumerate(rows) if d == c and j != i)
        wanted = min(k, sizes[c] - 1)
        r = near[wanted - 1]
        m = sum((x - r < y < x + r) if r > 0 else y == x for _, y in rows)
        total += psi(wanted) - psi(sizes[c]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows)) if rows else None


def cases(seed):
    r = random.Random(seed)
    free = [(r.choice("abc"), r.gauss(0, 1)) for _ in range(300)]
    tied = [(r.choice("ab"), float(r.randint(0, 6))) for _ in range(200)]
    hot = [("a", 5.0)] * 150 + [(r.choice("ab"), r.random() * 10) for _ in range(150)]
    told = [(c, 10.0 * "abc".index(c) + r.random()) for c in r.choices("abc", k=150)]
    lone = [("a", 1.0), ("b", 2.0), ("c", -0.0), ("c", 0.0), ("d", 4.0), ("d", 9.0), ("d", 4.0)]
    return [free, tied, hot, told, lone]


@pytest.mark.parametrize("seed,parts", [(1, 8), (2, 40)])
def test_all_distances(spark, seed, parts):
    sets = cases(seed)
    rows = [(f, c, x) for f, some in enumerate(sets) for c, x in some] + [(0, None, 1.0), (0, "a", None), (9, "z", 1.0)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["f"]: r["mi"] for r in neighbour_information(spark.createDataFrame(rows, "f int, c string, x double")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {f: pytest.approx(plain(some), abs=1e-9) for f, some in enumerate(sets)}
    assert neighbour_information(spark.createDataFrame([], "f int, c string, x double")).count() == 0


def test_digamma(spark):
    for n, value in spark.range(1, 60).select("id", digamma(F.col("id"))).collect():
        assert math.isclose(value, psi(n), abs_tol=1e-12)
