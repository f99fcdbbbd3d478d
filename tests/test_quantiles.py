"""The radix selection against a plain sort."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from framevitals.functions import quantiles
from framevitals.functions.quantiles import exact_quantiles

PROBS = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def check(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, ["v"], PROBS)["v"]
    want = np.quantile([v for v in values if v is not None], PROBS)
    assert got == pytest.approx(list(want), rel=1e-12, abs=1e-12)


@pytest.fixture(params=["plain", "deep", "narrow"])
def tight(request, monkeypatch):
    """Force the paths that only large data takes."""
    if request.param != "plain":
        monkeypatch.setattr(quantiles, "READ", 0)
    if request.param == "narrow":
        monkeypatch.setattr(quantiles, "BUDGET", 64)
    return request.param


def test_shapes(spark, tight):
    rng = np.random.default_rng(7)
    check(spark, [float(x) for x in rng.normal(size=400)])
    check(spark, [float(x) for x in rng.lognormal(0, 6, size=300)] + [-1e300, 1e300])
    check(spark, [1.0] * 200 + [2.0, 3.0] + [float(x) for x in range(50)])  # one value fills most of the column
    check(spark, [5.0])
    check(spark, [1.0, 2.0, None, 9.0, 2.0])


def test_extremes(spark, tight):
    """Infinities, subnormal numbers, both zeros, neighbours of powers of two, negative numbers: ranks without interpolation."""
    inf, tiny = float("inf"), 5e-324
    rng = np.random.default_rng(3)
    edges = [x for e in (-1074, -1022, -1010, -1, 0, 1, 52, 1023) for x in (2.0**e, -(2.0**e))]
    edges += [float(np.nextafter(x, y)) for x in edges for y in (-inf, inf)]
    values = [inf, -inf, -inf, 0.0, -0.0, tiny, -tiny, 3 * tiny, 1.7e308, -1.7e308, *edges] + [7.25] * 60
    values += [float(x) for x in rng.normal(size=60) * 10.0 ** rng.integers(-300, 300, 60)]
    values = sorted(values)
    probs = [i / (len(values) - 1) for i in range(0, len(values), 3)]
    ranks = [p * (len(values) - 1) for p in probs]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), ["v"], probs)["v"]
    for value, rank in zip(got, ranks):
        low, high = values[int(np.floor(rank))], values[int(np.ceil(rank))]
        assert low <= value <= high or value != value and low == -inf


def test_plan_is_linear_in_depth(spark, monkeypatch):
    """Deeper rounds have plans of the same length: zones are literals."""
    sizes = []
    counted = quantiles._counted

    def measured(values, keys):
        sizes.append(sum(len(str(k)) for k in keys.values()))
        return counted(values, keys)

    monkeypatch.setattr(quantiles, "READ", 0)
    monkeypatch.setattr(quantiles, "BITS", 4)
    monkeypatch.setattr(quantiles, "_counted", measured)
    df = spark.range(5000).selectExpr("rand(1) as v")
    exact_quantiles(df, ["v"], (0.25, 0.5))
    assert len(sizes) > 4 and max(sizes[1:]) < 2 * min(sizes[1:]) + 200


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], (0.5,)) == {"a": [None], "b": [1.0]}
    assert exact_quantiles(df, [], (0.5,)) == {}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=40))
def test_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, ["v"], PROBS)["v"]
    assert got == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-9, abs=1e-9)
