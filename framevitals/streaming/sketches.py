"""Running profile of a stream in mergeable sketches, kept in versions that a reader never meets half written.

A micro-batch becomes one row per column: counts, least and greatest value, a HyperLogLog sketch of the values and a KLL sketch of the numbers.
It is merged with the rows of the version before and stored as a version of its own, named after the batch. A version counts once
its writer has committed (``_SUCCESS``), and versions are never changed, so readers see the last whole one. A batch that is
repeated after a failure starts from the same version as the first time and replaces its own: nothing counts twice.
State and work of a trigger do not grow with the stream: the sketches have a fixed greatest size for each column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framevitals.functions import columns as C

STATE = "column string, rows bigint, missing bigint, low double, high double, seen binary, spread binary"
SHARES = (0.25, 0.5, 0.75)
KEPT = 2  # versions: the last one, and the one before for readers and repeated batches


def sketches(df: DataFrame) -> DataFrame:
    """column, rows, missing, low, high, seen, spread: one row per column of ``df``, from one aggregate.

    NaN is missing. ``low``, ``high`` and ``spread`` are of numbers (else NULL); nested columns have no ``seen``.
    """
    data = C.nan_to_null(df)
    families = C.families(data)
    aggs, cells = [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(data.columns):
        number = C.as_double(c) if families[c] in (C.INTEGER, C.FRACTIONAL) else F.lit(None).cast("double")
        text = C.ref(c).cast("string") if families[c] != C.NESTED else F.lit(None).cast("string")
        aggs += [
            F.count_if(C.ref(c).isNull()).alias(f"m{i}"), F.min(number).alias(f"l{i}"), F.max(number).alias(f"h{i}"),
            F.hll_sketch_agg(text).alias(f"s{i}"), F.kll_sketch_agg_double(number).alias(f"q{i}"),
        ]
        cells.append(F.struct(F.lit(c).alias("column"), "rows", *[F.col(f"{k}{i}").alias(n) for k, n in zip("mlhsq", ("missing", "low", "high", "seen", "spread"))]))
    return data.agg(*aggs).select(F.inline(F.array(*cells)))


def merged(states: DataFrame) -> DataFrame:
    """The state of all data behind ``states``: a row per column, whatever the order they were taken in."""
    return states.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("seen").alias("seen"), F.kll_merge_agg_double("spread").alias("spread"),
    )


def profile_of(states: DataFrame) -> DataFrame:
    """column, rows, missing, missing_pct, distinct_about, low, high, q25_about, q50_about, q75_about."""
    pct = F.round(F.col("missing") * 100.0 / F.nullif(F.col("rows").cast("double"), F.lit(0.0)), 2)
    numbers = F.col("low").isNotNull()
    quantile = [F.when(numbers, F.kll_sketch_get_quantile_double("spread", F.lit(q))).alias(f"q{round(100 * q)}_about") for q in SHARES]
    return states.select(
        "column", "rows", "missing", F.coalesce(pct, F.lit(0.0)).alias("missing_pct"),
        F.hll_sketch_estimate("seen").alias("distinct_about"), "low", "high", *quantile,
    )


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were committed, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "v-*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in found or ())


def _drop_version(spark: SparkSession, path: str, number: int) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path, f"v-{number}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def add_batch(batch: DataFrame, path: str, number: int) -> None:
    """Store the state after batch ``number`` as a version: that of the batches before, and this one."""
    spark = batch.sparkSession
    earlier = [v for v in _versions(spark, path) if v < number]
    state = sketches(batch)
    if earlier:
        state = merged(state.unionByName(spark.read.schema(STATE).parquet(f"{path}/v-{earlier[-1]}")))
    state.coalesce(1).write.mode("overwrite").parquet(f"{path}/v-{number}")  # a row for each column
    for old in earlier[: 1 - KEPT]:
        _drop_version(spark, path, old)


def sketch_stream(stream: DataFrame, path: str) -> None:
    """Bring the store at ``path`` up to date with all available input of ``stream``; the same call goes on where the last one ended."""
    query = (
        stream.writeStream.option("checkpointLocation", f"{path}/_progress")
        .foreachBatch(lambda batch, number: add_batch(batch, path, number))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The profile in the last whole version at ``path``; no rows when there is none."""
    found = _versions(spark, path)
    states = spark.read.schema(STATE).parquet(f"{path}/v-{found[-1]}") if found else C.small_frame(spark, STATE, [])
    return profile_of(states)
