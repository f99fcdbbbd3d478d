"""Shapes that only large or skewed data has."""

from framevitals.operators import correlation, leakage, lookup
from framevitals.operators.profile import column_report, summary
from pyspark.sql import functions as F


def test_wide_frame(spark):
    df = spark.range(20).select("id", *[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(250)])
    got = {r["column"]: r["n_unique"] for r in column_report(df).collect()}
    assert len(got) == 251 and got["id"] == 20 and got["c0"] == 2 and got["c249"] == 20
    row = summary(df).first()
    assert (row["rows"], row["cols"], row["duplicates"]) == (20, 251, 0)


def test_many_equal_columns(spark):
    df = spark.range(30).select("id", *[F.lit(0).alias(f"z{i}") for i in range(60)], (F.col("id") * 1.0).alias("copy"))
    got = {r["column"]: r["duplicate_of"] for r in leakage.duplicate_columns(df).collect()}
    assert got == {"copy": "id", **{f"z{i}": "z0" for i in range(1, 60)}}


def test_many_pairs(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(f"c{i}") for i in range(12)])
    assert correlation.corr_matrix(df).count() == 66


def test_attach_keeps_every_row(spark):
    df = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 0, if(id % 11 = 0, null, id)) as k")
    entries = df.where("k is not null").groupBy(F.col("k").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    entries = entries.where("value % 2 = 0").withColumn("found", F.col("value") + 1)
    small = lookup.attach(df, F.col("k"), entries, "out")
    large = lookup.attach(df, F.col("k"), entries, "out", small=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert large.count() == 6000
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Union" in plan
