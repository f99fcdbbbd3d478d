"""Plans must stay cluster-shaped."""


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned(spark, sf_dir):
    from framevitals.operators.labels import imbalance

    plan = plan_of(imbalance(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag"))
    assert "ReadSchema: struct<l_returnflag:string>" in plan


def test_dedupe_combines_before_the_shuffle(spark, sf_dir):
    from framevitals.operators.cleaning import remove_duplicates

    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for plan in (
        plan_of(remove_duplicates(df, ["o_custkey"], "first", ["o_orderdate"])),
        plan_of(remove_duplicates(df)),
    ):
        assert plan.count("Aggregate(") >= 2 and "Window" not in plan


def test_graph_keeps_errors_in_place(spark):
    import pytest

    from framevitals.plans.schedule import Task, run_graph

    def fails(_):
        spark.sql("select raise_error('only while it runs')").collect()

    tasks = {
        "a": Task(lambda _: 1),
        "b": Task(fails),
        "c": Task(lambda known: known["a"] + 1, ("a",)),
        "d": Task(lambda known: known["b"], ("a", "b")),
        "e": Task(lambda known: sorted(known), ("a", "b", "c"), tolerant=True),
    }
    found = run_graph(spark, tasks)
    assert list(found) == list(tasks) and found["c"].value == 2 and found["e"].value == ["a", "c"]
    assert "only while it runs" in found["b"].error and found["d"].error.startswith("needs b: ")
    with pytest.raises(ValueError, match="unknown"):
        run_graph(spark, {"a": Task(fails, ("z",))})
    with pytest.raises(ValueError, match="each other"):
        run_graph(spark, {"a": Task(fails, ("b",)), "b": Task(fails, ("a",))})


def test_report_of_a_continuous_target_stays_small(spark):
    from framevitals import full_report

    df = spark.range(3000).selectExpr("id", "cast(id * 1.5 as double) as price", "cast(id % 3 as string) as kind")
    sections = {r["section"]: r["count"] for r in full_report(df, "price", checks=()).groupBy("section").count().collect()}
    assert "class" not in sections and sum(sections.values()) < 200
    kinds = full_report(df, "kind", checks=()).where("section = 'class' and metric = 'n'").collect()
    assert sorted((r["item"], r["num"]) for r in kinds) == [("0", 1000.0), ("1", 1000.0), ("2", 1000.0)]
