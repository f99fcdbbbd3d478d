import numpy as np
import math

import pytest

from framevitals.operators import correlation, labels, leakage, predictive


def test_corr_and_risk(spark, one):
    y = list(range(1, 11))
    h = [2, 1, 4, 3, 6, 5, 8, 7, 10, 9]
    g = [1, 2, 3, 4, 5, 6, 7, 9, 8, 6]
    rows = [(float(a), 2.0 * a, float(b), float(c), 7.0) for a, b, c in zip(y, h, g)]
    df = spark.createDataFrame(rows, "y double, p double, h double, g double, same double")
    got = one(correlation.corr_target(df, "y"), "feature")
    assert got["p"]["band"] == "perfect" and got["h"]["band"] == "high" and got["g"]["band"] is None
    assert got["h"]["r"] == pytest.approx(0.939394, abs=1e-6) and got["g"]["r"] == pytest.approx(0.895856, abs=1e-6)
    assert got["same"]["r"] is None
    assert leakage.leakage(df, "y").first()["risk"] == "HIGH"
    assert leakage.leakage(df.drop("p"), "y").first()["risk"] == "LOW"
    assert leakage.leakage(df.drop("p", "h"), "y").first()["risk"] == "NONE"
    none = leakage.leakage(df, None).first()
    assert none["risk"] == "NONE" and none["details"] == "no valid target"


def test_pairwise_complete(spark, one):
    rows = [(1.0, 1.0), (2.0, 2.0), (3.0, None), (None, 4.0), (3.0, 3.0)]
    df = spark.createDataFrame(rows, "y double, x double")
    assert one(correlation.corr_target(df, "y"), "feature")["x"]["r"] == pytest.approx(1.0)


def test_duplicate_columns(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 2, "a", "a", None, None), (2, 2.0, 1, "b", "b", None, None), (None, None, None, "c", "d", None, None)],
        "i int, f double, swapped int, s string, t string, e1 int, e2 string",
    )
    got = {r["column"]: r["duplicate_of"] for r in leakage.duplicate_columns(df).collect()}
    assert got == {"f": "i", "e2": "e1"}
    assert leakage.duplicate_columns(df, exclude=["i"]).count() == 1
    flags = spark.createDataFrame([(True, 1), (False, 0)], "b boolean, n int")
    assert leakage.duplicate_columns(flags).first()["duplicate_of"] == "b"


def test_imbalance_edges(spark):
    def severity(share):
        df = spark.range(100).selectExpr(f"if(id < {share}, 'a', 'b') as t")
        return labels.imbalance(df, "t").first()

    assert [severity(s)["severity"] for s in (95, 80, 60, 50)] == ["EXTREME", "HIGH", "MODERATE", "LOW"]
    assert severity(80)["is_imbalanced"] and not severity(60)["is_imbalanced"]
    gaps = spark.createDataFrame([(1,), (1,), (None,), (None,)], "t int")
    row = labels.imbalance(gaps, "t").first()
    assert (row["num_classes"], row["majority_ratio"], row["missing_ratio"]) == (2, 0.5, 0.5)
    many = spark.range(1001).selectExpr("id as t")
    assert labels.imbalance(many, "t").first()["details"] == "target has too many distinct values"
    assert labels.class_distribution(many, "t").count() == 1001  # every class, at any number
    empty = labels.imbalance(many.where("t < 0"), "t").first()
    assert empty["details"] == "target column is empty" and empty["is_imbalanced"] is False


def test_mutual_information(spark, one):
    df = spark.range(100).selectExpr("cast(id % 2 as string) as y", "cast(id % 2 as string) as x", "cast(id div 2 % 2 as string) as z")
    got = one(predictive.mutual_information(df, "y"), "feature")
    assert got["x"]["mi"] == pytest.approx(math.log(2)) and got["z"]["mi"] == pytest.approx(0.0, abs=1e-12)
    back = one(predictive.mutual_information(df, "x"), "feature")
    assert back["y"]["mi"] == pytest.approx(got["x"]["mi"])


def test_predictive_power(spark, one):
    df = spark.range(600).selectExpr(
        "id", "id % 2 as y", "id % 2 as leak", "id % 3 as noise", "if(id % 5 = 0, null, id * 1.0D) as gap", "1 as same"
    )
    got = one(predictive.predictive_power(df, "y", ["id"]), "feature")
    assert got["leak"]["leakage_risk"] and got["leak"]["score"] > 0.5
    assert not got["noise"]["leakage_risk"] and got["noise"]["score"] < 0.05
    assert "gap_missing" in got and "same" not in got
    again = one(predictive.predictive_power(df.repartition(5), "y", ["id"]), "feature")
    assert again == got
    assert predictive.predictive_power(df.where("id < 0"), "y").count() == 0


def test_task(spark):
    df = spark.range(1000).selectExpr("id % 5 as few", "id", "id * 1.5 as real", "cast(id as string) as word", "id > 3 as flag")
    got = {t: predictive.task_type(df, t).first()["task"] for t in df.columns}
    assert got == {"few": "classification", "id": "regression", "real": "regression", "word": "classification", "flag": "classification"}


def test_label_conflicts(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 2, 0), ("b", 2, 0)], "f string, g int, y int")
    assert [tuple(r) for r in labels.label_conflicts(df, "y").collect()] == [("a", 1, 2, 2)]


def test_matrix_in_one_scan(spark):
    """Gaps, constants, infinities and far values, over many batches, against numpy on the pairs that are there."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 5)) * [1, 1e-6, 1e9, 1, 1] + [0, 1e3, 1e12, 0, 0]
    x[:, 3] = 2 * x[:, 0] + 0.1 * x[:, 3]
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(*[None if np.isnan(v) else float(v) for v in r], 0.1, None, float("inf") if i == 5 else 1.0 * i) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, fixed double, none double, far double").repartition(7)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r["x"], r["y"]): r["r"] for r in correlation.corr_matrix(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 28
    for i, j in ((i, j) for i in range(5) for j in range(i + 1, 5)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got["abcde"[i], "abcde"[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-7)
    assert got["a", "fixed"] is None and got["a", "none"] is None and np.isnan(got["a", "far"])
    assert correlation.corr_matrix(df.select("a")).count() == 0
    assert {r["r"] for r in correlation.corr_matrix(df.where("a > 1e99").select("a", "b")).collect()} == {None}
