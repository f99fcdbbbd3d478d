"""Incremental profile of a stream, and a streaming audit sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framevitals.functions import columns as C
from framevitals.sources.scratch import fresh_path


def running_counts(stream: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """rows and per-column missing counts as one running aggregate (any frame, streaming or not)."""
    data = C.nan_to_null(stream)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(data.columns):
        aggs.append(F.count_if(C.ref(c).isNull()).alias(f"missing_{i}"))
        if approx_distinct and C.families(data)[c] != C.NESTED:
            aggs.append(F.approx_count_distinct(C.ref(c)).alias(f"unique_{i}"))
    return data.agg(*aggs)


def long_form(counts: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, missing, missing_pct from the one-row running counts."""
    cells = [x for i, c in enumerate(columns) for x in (F.lit(c), F.col(f"missing_{i}"))]
    pct = F.round(F.col("missing") * 100.0 / F.nullif(F.col("rows").cast("double"), F.lit(0.0)), 2)
    return counts.select("rows", F.stack(F.lit(len(columns)), *cells).alias("column", "missing")).select(
        "column", "rows", "missing", F.coalesce(pct, F.lit(0.0)).alias("missing_pct")
    )


def profile_stream(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> str:
    """Keep the profile of a stream up to date at ``path`` until all available input is read.

    State is one row whatever the input size. Each trigger overwrites the stored profile, so
    a reader always sees a complete one; a restart goes on from ``checkpoint``.
    """
    spark = stream.sparkSession
    out = path or fresh_path(spark, "profile")
    columns = stream.columns

    def publish(batch: DataFrame, _: int) -> None:
        long_form(batch, columns).write.mode("overwrite").parquet(out)

    query = (
        running_counts(stream)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint or fresh_path(spark, "profile-state"))
        .foreachBatch(publish)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out


def append_stream(entries: DataFrame, path: str, checkpoint: str | None = None) -> str:
    """Append a stream of audit entries to a Parquet log, each exactly once."""
    query = (
        entries.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint or fresh_path(entries.sparkSession, "audit-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path
