import datetime as dt

import pytest
from pyspark.sql import functions as F

from framevitals.functions import bands
from framevitals.functions.columns import blank_to_null, check_target, nan_to_null, sanitize_names, small_frame
from framevitals.operators import quality, statistics
from framevitals.operators.profile import ColumnInfo, Profile, column_report, duplicates, profile, summary


@pytest.fixture(scope="module")
def mix(spark):
    day = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [(1, "x", True, day[0], 1.0), (2, None, False, day[1], 2.0), (2, "y", True, None, 2.0), (None, "y", True, day[2], None)]
    return spark.createDataFrame(rows, "a int, b string, c boolean, d timestamp_ntz, e double")


def test_column_report(mix, one):
    got = one(column_report(mix))
    assert {c: got[c]["missing_pct"] for c in "abcde"} == {"a": 25.0, "b": 25.0, "c": 0.0, "d": 25.0, "e": 25.0}
    assert {c: got[c]["n_unique"] for c in "abcde"} == {"a": 2, "b": 2, "c": 2, "d": 3, "e": 2}
    approx = one(column_report(mix, approx=True))
    assert {c: approx[c]["n_unique"] for c in "abcde"} == {c: got[c]["n_unique"] for c in "abcde"}


def test_summary(mix):
    row = summary(mix).first()
    assert (row["rows"], row["cols"], row["missing_pct"], row["duplicates"]) == (4, 5, 20.0, 0)
    assert summary(mix, with_duplicates=False).first()["missing_pct"] == 20.0


def test_statistics(mix, one):
    a = one(statistics.stats_numeric(mix))["a"]
    assert (a["count"], a["q25"], a["q50"], a["q75"]) == (3, 1.5, 2.0, 2.0)
    assert a["mean"] == pytest.approx(1.666667, abs=1e-6) and a["std"] == pytest.approx(0.57735, abs=1e-5)
    cat = one(statistics.stats_categorical(mix))
    assert (cat["b"]["n_unique"], cat["b"]["top"], cat["b"]["freq"]) == (2, "y", 2)
    assert (cat["c"]["n_unique"], cat["c"]["top"], cat["c"]["freq"]) == (2, "true", 3)
    assert one(statistics.stats_datetime(mix))["d"]["mean"] == dt.datetime(2024, 1, 2)


def test_top_tie_is_smallest(spark, one):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",)], "v string")
    assert one(statistics.stats_categorical(df))["v"]["top"] == "a"


def test_empty(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert column_report(df).count() == 0
    row = summary(df).first()
    assert (row["rows"], row["missing_pct"], row["duplicates"], row["duplicates_pct"]) == (0, 0.0, 0, 0.0)
    p = profile(df)
    assert p.rows == 0 and quality.quality(p).first()["score"] == 0.0
    assert statistics.stats_numeric(df).first()["q50"] is None
    assert statistics.outliers(df).count() == 0 and statistics.stats_categorical(df).count() == 0


def test_nan_is_missing(spark, one):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    assert one(column_report(df))["v"]["missing"] == 2
    assert one(statistics.stats_numeric(df))["v"]["mean"] == 1.0
    assert nan_to_null(df).where("v is null").count() == 2


def test_blank(spark):
    df = spark.createDataFrame([("",), (" ",), ("\t",), ("a",), (None,)], "v string")
    assert [r["v"] for r in blank_to_null(df).collect()] == [None, None, None, "a", None]


def test_iqr(spark, one):
    rows = [(float(x), 5.0) for x in (1, 2, 3, 4, 5, 6, 7, 8, 9, 100)]
    got = one(statistics.outliers(spark.createDataFrame(rows, "v double, same double")))
    v = got["v"]
    assert (v["q1"], v["q3"], v["lower"], v["upper"], v["outliers"], v["ratio"]) == (3.25, 7.75, -3.5, 14.5, 1, 0.1)
    assert "same" not in got


def test_skewness(spark, one):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, None), (9.0, None)], "a double, b double")
    got = one(statistics.skewness(df))
    assert got["a"]["skewness"] == pytest.approx(1.900104, abs=1e-6) and got["b"]["skewness"] is None


def made(spark, rows, cols, missing, n_unique, dups):
    infos = tuple(ColumnInfo(i, f"c{i}", "int", "integer", missing[i], n_unique[i]) for i in range(cols))
    return Profile(spark, rows, dups, infos)


def test_quality(spark):
    p = made(spark, 10, 4, [0] * 4, [5, 5, 5, 1], 2)
    q = quality.quality(p).first()
    assert (q["missing_ratio"], q["duplicate_ratio"], q["constant_ratio"], q["score"]) == (0.0, 0.2, 0.25, 90.0)
    r = quality.ml_readiness(p).first()
    assert r["value"] == 78 and [tuple(x) for x in r["penalties"]] == [("low_sample_size", 20), ("duplicate_rows", 10)]
    worst = quality.quality(made(spark, 10, 2, [10, 10], [0, 0], 10)).first()
    assert worst["score"] == 15.0
    assert quality.ml_readiness(p, True, use_quality=False).first()["value"] == 60


def test_suggestions(spark):
    infos = (ColumnInfo(0, "update_flag", "int", "integer", 0, 2), ColumnInfo(1, "gap", "int", "integer", 4, 1))
    got = [r["suggestion"] for r in quality.suggestions(Profile(spark, 10, 0, infos)).orderBy("position", "rule").collect()]
    assert got == [
        "update_flag: potential datetime → extract temporal features",
        "gap: constant value detected → drop column",
        "gap: high missing (40.00%) → impute or drop",
    ]


def test_duplicates_with_long_text(spark):
    long = "word " * 1000
    df = spark.createDataFrame([(1, long), (1, long), (1, long + "x"), (None, None), (None, None)], "k int, t string")
    row = duplicates(df).first()
    assert (row["rows"], row["duplicates"]) == (5, 2)


def test_result_does_not_depend_on_partitions(mix):
    a = sorted(map(tuple, column_report(mix.repartition(1)).collect()))
    b = sorted(map(tuple, column_report(mix.repartition(7)).collect()))
    assert a == b


def test_names_and_target(spark):
    df = spark.createDataFrame([(1, 2)], "`a-b` int, `c d` int")
    assert sanitize_names(df).columns == ["ab", "c d"]
    with pytest.raises(ValueError):
        sanitize_names(spark.createDataFrame([(1, 2)], "`a-b` int, `ab` int"))
    assert check_target(df, " c d ") == "c d"
    for bad in ("", "nope"):
        with pytest.raises(ValueError):
            check_target(df, bad)
    assert column_report(spark.createDataFrame([(1,)], "`a.b` int")).first()["column"] == "a.b"


def test_bands(spark):
    df = small_frame(spark, "v double", [(0.95,), (0.94,), (0.8,), (0.79,), (0.6,), (0.59,)])
    got = [r[0] for r in df.select(bands.imbalance_severity(F.col("v"))).collect()]
    assert got == ["EXTREME", "HIGH", "HIGH", "MODERATE", "MODERATE", "LOW"]
    shown = small_frame(spark, "v bigint", [(999,), (1500,), (2_000_000,)]).select(bands.magnitude(F.col("v")))
    assert [r[0] for r in shown.collect()] == ["999", "1.5k", "2.0M"]
