import datetime as dt

import pytest
from pyspark.sql import functions as F

from framevitals.operators import cleaning
from framevitals.operators.profile import column_report
from framevitals.plans.recipe import clean
from framevitals.plans.registry import get_step, list_checks, register_check, register_step, run_checks


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [(1, "a", 1), (1, "b", 2), (2, "c", 3), (None, "d", 4), (None, "e", 5)]
    return spark.createDataFrame(rows, "k int, v string, ord int")


@pytest.mark.parametrize("keep, want", [("first", "acd"), ("last", "bce"), (False, "c")])
def test_dedupe_subset(keyed, keep, want):
    got = cleaning.remove_duplicates(keyed, ["k"], keep, ["ord"])
    assert got.columns == keyed.columns
    assert sorted(r["v"] for r in got.collect()) == list(want)
    removed = cleaning.dedupe_log(keyed, ["k"], keep).first()["duplicates_removed"]
    assert removed == keyed.count() - len(want)


def test_dedupe_hot_key(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as ord", "cast(id as string) as v")
    first = cleaning.remove_duplicates(df, ["k"], "first", ["ord"])
    assert first.count() == 2001 and first.where("k = 0").first()["ord"] == 0
    assert cleaning.remove_duplicates(df, ["k"], "last", ["ord"]).where("k = 0").first()["ord"] == 2997


def test_dedupe_is_idempotent_and_keeps_maps(spark):
    df = spark.createDataFrame([(1, {"a": 1}, 1), (1, {"a": 2}, 2)], "k int, m map<string,int>, ord int")
    got = cleaning.remove_duplicates(df, ["k"], "last", ["ord"])
    assert [r["m"] for r in got.collect()] == [{"a": 2}]
    again = cleaning.remove_duplicates(got, ["k"], "last", ["ord"])
    assert again.collect() == got.collect()
    with pytest.raises(ValueError):
        cleaning.remove_duplicates(df, ["k"], "some")


def test_impute(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (2.0, None), (9.0, "b"), (None, "a")], "n double, s string")
    out, log = cleaning.impute(df, "n")  # skewed: median
    assert log["strategy_used"] == "median" and out.where("n is null").count() == 0
    assert sorted(r["n"] for r in out.collect()) == [1.0, 2.0, 2.0, 2.0, 9.0]
    out, log = cleaning.impute(df, "s")
    assert (log["strategy_used"], log["fill_value"], log["nulls_fixed"]) == ("mode", "a", 1)
    same, log = cleaning.impute(out, "s")
    assert log["imputed"] is False and same is out
    with pytest.raises(ValueError):
        cleaning.impute(df, "s", "mean")
    with pytest.raises(ValueError):
        cleaning.impute(df, "n", "nonsense")


def test_impute_short_column_uses_mean_and_dates(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, None), (None, dt.datetime(2024, 1, 3))], "n int, d timestamp_ntz")
    out, log = cleaning.impute(df, "n")
    assert log["strategy_used"] == "mean" and dict(out.dtypes)["n"] == "double"
    out, _ = cleaning.impute(df, "d", "mean")
    assert out.where("d = timestamp_ntz'2024-01-02 00:00:00'").count() == 1
    out, _ = cleaning.impute(df, "d", "median")
    assert dict(out.dtypes)["d"] == "timestamp_ntz" and out.where("d is null").count() == 0


def cast_all(spark, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out, log = cleaning.cast_column(df, "v", kind)
    return [r["v"] for r in out.orderBy("i").collect()], log


def test_casts(spark):
    assert cast_all(spark, ["0.5", "1.5", "2.5", "-0.5", "x"], "int")[0] == [0, 2, 2, 0, None]
    assert cast_all(spark, ["1", "0", "True", "1.0", "yes", " FALSE "], "bool")[0] == [True, False, True, None, None, False]
    assert cast_all(spark, ["b", "a", None, "c", "a"], "encode")[0] == [1, 0, None, 2, 0]
    assert cast_all(spark, [" 1.5", "NaN", "bad"], "float")[0] == [1.5, None, None]
    assert cast_all(spark, ["2024-01-02", "01/03/2024", "no"], "date")[0] == [dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3), None]
    got, log = cast_all(spark, ["1", "2.0", None], "auto")
    assert got == [1, 2, None] and log["strategy_used"] == "int"
    for kind in ("auto", "nonsense"):
        with pytest.raises(ValueError):
            cast_all(spark, ["a", "1"], kind)
    nums = spark.createDataFrame([(1.0,), (0.0,), (3.0,)], "v double")
    assert [r[0] for r in cleaning.cast_column(nums, "v", "bool")[0].collect()] == [True, False, None]


def test_encode_large_path_with_hot_value(spark):
    df = spark.range(4000).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 7 = 0, null, concat('v', id))) as v")
    small = {r["id"]: r["v"] for r in cleaning.label_encode(df, "v").collect()}
    large = {r["id"]: r["v"] for r in cleaning.label_encode(df, "v", small=0).collect()}
    assert small == large and len(small) == 4000


def test_recipe_log(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, t string")
    steps = [
        {"action": "drop_columns", "columns": ["nope"]},
        {"action": "unheard_of"},
        {"action": "smart_impute", "columns": ["t"], "method": "mean"},
        {"action": "remove_duplicates"},
        {"action": "cast_schema", "columns": ["k"], "method": "float"},
    ]
    done = clean(df, steps)
    log = {(r["step_no"], r["metric"]): r for r in done.log.collect()}
    assert log[(1, "count")]["value"] == "0" and log[(2, "reason")]["status"] == "skipped"
    assert log[(3, None)]["status"] == "failed" and "not numeric" in log[(3, None)]["error"]
    assert log[(4, "duplicates_removed")]["value"] == "1"
    assert done.frame.count() == 2 and done.declared == {"k": "double"}
    assert dict(done.frame.dtypes)["k"] == "double"


def test_registry(spark):
    with pytest.raises(ValueError):
        register_check("")
    with pytest.raises(ValueError):
        run_checks(spark.range(3), ["not_there"])
    name = "always_fails"
    if name not in list_checks():

        @register_check(name)
        def _fails(df, target, profile, context):
            raise RuntimeError("boom")

    with pytest.raises(ValueError):
        register_check(name)(lambda df, target, profile, context: df)
    from framevitals.plans.checks import STANDARD

    df = spark.range(200).selectExpr("id", "id % 2 as flag", "id * 2 as twice")
    got = run_checks(df, [name, *STANDARD], target="flag")
    assert got[name].first()["error"] == "boom"
    assert got["data_quality"].first()["score"] == 100.0 and got["ml_readiness"].first()["value"] == 100
    assert all("error" not in got[n].columns for n in STANDARD)
    register_step("twice_defined")(lambda df, **_: (df, {"v": 1}))
    register_step("twice_defined")(lambda df, **_: (df, {"v": 2}))
    assert get_step("twice_defined")(df)[1] == {"v": 2}


def test_declared_types(spark, one):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    out = cleaning.apply_schema(df, {"v": "int", "nope": "int"})
    assert one(column_report(out))["v"]["missing"] == 1
    assert out.where(F.col("v") == 1).count() == 1


def test_type_change_in_drift(spark):
    from framevitals.operators.drift import drift_psi

    old = spark.range(1000).selectExpr("id as n", "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 60 as int)) as t", "id as same")
    new = spark.range(1000).selectExpr("if(id % 10 = 0, 'n/a', cast(id as string)) as n", "cast('2024-01-05' as string) as t", "cast(id as double) as same")
    got = {r["column"]: r for r in drift_psi(old, new).collect()}
    assert {c: r["band"] for c, r in got.items()} == {"n": "type changed", "t": "type changed", "same": "stable"}
    assert 0.3 < got["n"]["psi"] < 1.5


def test_constants_that_do_not_fit(spark):
    import pytest

    from framevitals.operators.cleaning import impute

    df = spark.createDataFrame([(1,), (None,)], "n int")
    assert sorted(r[0] for r in impute(df, "n", "constant", 1.5)[0].collect()) == [1.0, 1.5]
    assert sorted(r[0] for r in impute(df, "n", "constant", "7")[0].collect()) == [1, 7]
    with pytest.raises(ValueError, match="no value"):
        impute(df, "n", "constant", "abc")
