"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.texts import written


def _least(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "stars")


def _settled(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component's id is its smallest node.

    A step hangs the neighbours of each node onto the smallest of them; their number halves the distances, so a
    chain takes logarithmically many steps. Least neighbours combine before the shuffle, and the join
    back to the edges has plain rows on both sides, so Spark can split the neighbours of a hub.
    """
    state = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while before != (now := _settled(state)):
        before = now
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = written(large.where("u <> v").distinct(), "edges")
        joined = large.join(_least(large), "u")
        onto = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        state = written(joined.select(onto.alias("e")).select("e.*").where("u > v").distinct(), "edges")
    roots = state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return written(roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct()), "components")
