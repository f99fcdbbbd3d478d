"""Values that are easily lost: long integers, letters after digits, NaN beside NULL, many classes."""

import math

import pytest

from framevitals.functions import casts
from framevitals.functions import columns as C
from framevitals.operators import cleaning, labels
from framevitals.plans.recipe import clean
from pyspark.sql import functions as F


def test_long_integers_stay_exact(spark):
    texts = ["123456789012345679", " 9007199254740993 ", "+7", "2.5", "1e3", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "v string").select(casts.to_int(F.col("v"), C.STRING).alias("v"))
    assert [r.v for r in df.collect()] == [123456789012345679, 9007199254740993, 7, 2, 1000, None]


@pytest.mark.parametrize("text,want", [("1D", None), ("2f", None), ("7d", None), ("0x1", None), ("1e5", 1e5), ("-.5", -0.5), ("inf", math.inf)])
def test_only_numbers_are_numbers(spark, text, want):
    df = spark.createDataFrame([(text,)], "v string").select(casts.to_float(F.col("v"), C.STRING).alias("v"))
    assert df.first().v == want


def test_nan_is_null_for_duplicates(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, 1.0)], "a int, b double")
    assert cleaning.remove_duplicates(df).count() == 2


def test_every_class_is_counted(spark):
    df = spark.range(60_000).select(F.when(F.col("id") < 1500, F.col("id")).otherwise(-1).alias("y"))
    assert labels.class_distribution(df, "y").count() == 1501
    row = labels.imbalance(df, "y").first()
    assert row.num_classes == 1501 and row.is_imbalanced and row.details == "target has too many distinct values"


def test_further_columns_of_a_step_are_not_passed_over(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, 2.0)], "a int, b double, c double")
    log = clean(df, [{"action": "smart_impute", "columns": ["b", "c"], "method": "mean"}]).log.collect()
    assert "failed" in str(log[0])
