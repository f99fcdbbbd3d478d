"""Bounded samples of labelled texts: at most ``per_class`` distinct texts of each label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, chars: int, cut: bool) -> list[tuple]:
    """(label, hash, text) of the texts with the smallest hashes per label; copies of a text count once.

    ``labels`` has doc_id and label, one row or more per document. With ``cut`` a longer text gives its first ``chars``
    characters, else it is passed over: either way the sample holds at most ``labels * per_class * chars``
    characters, whatever the corpus. Ranking goes in two steps, first within ``PARTS`` parts of a label, and keeps
    ``per_class`` rows of each task before either shuffle, so a label with most of the rows floods no task. Rows without text, id or label are passed over.
    """
    usable = docs.where("doc_id is not null and text is not null")
    if not cut:
        usable = usable.where(F.length("text") <= chars)
    hashed = usable.select("doc_id", F.xxhash64("text").alias("h"))
    known = labels.where("doc_id is not null and label is not null").select("doc_id", "label")
    one = hashed.join(known, "doc_id").groupBy("label", "h").agg(F.min("doc_id").alias("doc_id"))
    picked = one.withColumn("part", F.pmod("h", F.lit(PARTS)))
    for keys in (("label", "part"), ("label",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        picked = picked.withColumn("place", place).where(F.col("place") <= per_class).drop("place")
    picked = picked.select("label", "doc_id")
    text = F.substring("text", 1, chars) if cut else F.col("text")
    rows = usable.join(F.broadcast(picked), "doc_id").select("label", F.xxhash64("text").alias("h"), text.alias("text"))
    return sorted({(r["label"], r["h"], r["text"]) for r in rows.collect()})
