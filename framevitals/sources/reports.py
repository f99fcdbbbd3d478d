"""Report store: one folder per data set and section; writing a section replaces it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from framevitals.functions import columns as C
from framevitals.sources.scratch import checkpointed

REPORT_SCHEMA = "section string, item string, metric string, num double, txt string"
DAMAGED = "damaged"
EMPTY_STATE = ("status", "dataset", "state", None, "processing")


def save_report(report: DataFrame, path: str, dataset_id: str) -> None:
    """Write report rows as JSON; sections present in ``report`` replace the stored ones, others stay."""
    (
        report.withColumn("dataset_id", F.lit(dataset_id))
        .repartition("dataset_id", "section")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_id", "section")
        .json(path)
    )


def load_report(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """The stored rows of one data set; a single 'processing' row when there are none.

    Lines that are no report row (half written, not JSON, a value of another type) are left out; their number is one more row,
    'damaged_lines' of the 'status' section.
    """
    try:
        stored = (
            spark.read.schema(f"{REPORT_SCHEMA}, dataset_id string, {DAMAGED} string")
            .option("columnNameOfCorruptRecord", DAMAGED)
            .json(path)
            .where(F.col("dataset_id") == dataset_id)
        )
        # kept, as the reader prunes columns and would then not look at whole lines; a report is small
        stored = checkpointed(stored.select("section", "item", "metric", "num", "txt", DAMAGED))
    except AnalysisException:
        return C.small_frame(spark, REPORT_SCHEMA, [EMPTY_STATE])
    whole = F.col(DAMAGED).isNull() & F.col("metric").isNotNull()
    counts = stored.agg(F.count_if(whole).alias("good"), F.count_if(~whole).alias("bad")).first()
    rows = [] if counts["good"] else [EMPTY_STATE]
    if counts["bad"]:
        rows.append(("status", "dataset", "damaged_lines", float(counts["bad"]), None))
    good = stored.where(whole).drop(DAMAGED)
    return good.unionByName(C.small_frame(spark, REPORT_SCHEMA, rows)) if rows else good


def as_document(report: DataFrame) -> DataFrame:
    """One row per section: the section's rows as one JSON text (report-sized data only)."""
    entry = F.struct("item", "metric", F.coalesce(F.col("num").cast("string"), F.col("txt")).alias("value"))
    return report.groupBy("section").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("document"))
