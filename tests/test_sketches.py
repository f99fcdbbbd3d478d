"""Sketches of micro-batches merged to the profile of all data, and versions that survive repeated batches."""

import math

import pytest
from pyspark.sql import functions as F

from framevitals.sources.scratch import fresh_path
from framevitals.streaming.sketches import _versions, add_batch, merged, profile_of, read_sketches, sketch_stream, sketches

EXACT = ["column", "rows", "missing", "missing_pct", "distinct_about", "low", "high"]


def rows_of(df):
    return sorted(map(tuple, df.select(*EXACT).collect()), key=str)


@pytest.fixture
def data(spark):
    return spark.range(3000).selectExpr(
        "id", "id % 3 as part", "if(id % 7 = 0, null, if(id % 11 = 0, double('NaN'), id / 8)) as x",
        "case when id % 3 = 0 then 'hot' when id % 5 = 0 then null else cast(id % 40 as string) end as s", "array(id) as nested",
    )


def test_batches_equal_the_whole(spark, data):
    path = fresh_path(spark, "sketches")
    for i in range(3):
        add_batch(data.where(F.col("part") == i), path, i)
    got = {r["column"]: r for r in read_sketches(spark, path).collect()}
    whole = {r["column"]: r for r in profile_of(sketches(data)).collect()}
    for name in ("rows", "missing", "missing_pct", "low", "high"):
        assert {c: r[name] for c, r in got.items()} == {c: r[name] for c, r in whole.items()}
    missing = data.where("x is null or isnan(x)").count()
    assert got["x"]["missing"] == missing and got["s"]["rows"] == 3000 and got["part"]["distinct_about"] == 3
    assert got["s"]["low"] is None and got["s"]["q50_about"] is None and got["nested"]["distinct_about"] == 0
    values = sorted(r[0] for r in data.where("x is not null and not isnan(x)").select("x").collect())
    assert abs(sum(v < got["x"]["q50_about"] for v in values) / len(values) - 0.5) < 0.03
    assert math.isclose(got["id"]["distinct_about"], 3000, rel_tol=0.06)


def test_a_repeated_batch_counts_once(spark, data):
    path = fresh_path(spark, "sketches")
    add_batch(data, path, 0)
    add_batch(data.limit(10), path, 1)
    before = rows_of(read_sketches(spark, path))
    add_batch(data.limit(10), path, 1)
    assert rows_of(read_sketches(spark, path)) == before
    add_batch(data.where("id < 0"), path, 2)  # an empty batch changes nothing
    assert rows_of(read_sketches(spark, path)) == before and _versions(spark, path) == [1, 2]


def test_a_version_without_its_commit_is_not_read(spark, data):
    path = fresh_path(spark, "sketches")
    add_batch(data, path, 0)
    before = rows_of(read_sketches(spark, path))
    conf = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    sketches(data).write.option(conf, "false").parquet(f"{path}/v-1")
    assert rows_of(read_sketches(spark, path)) == before


def test_stream_goes_on_where_it_ended(spark, data):
    source, path = fresh_path(spark, "source"), fresh_path(spark, "sketches")
    assert read_sketches(spark, path).count() == 0

    def run():
        sketch_stream(spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(source), path)

    data.where("part < 2").repartition(2).write.parquet(source)
    run()
    data.where("part = 2").coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    got = {r["column"]: r for r in read_sketches(spark, path).collect()}
    assert got["id"]["rows"] == 3000 and (got["id"]["low"], got["id"]["high"]) == (0.0, 2999.0)


def test_merging_has_no_order(spark, data):
    some = [sketches(data.where(F.col("part") == i)) for i in range(3)]
    left = merged(merged(some[0].unionByName(some[1])).unionByName(some[2]))
    right = merged(some[2].unionByName(merged(some[1].unionByName(some[0]))))
    assert rows_of(profile_of(left)) == rows_of(profile_of(right))
