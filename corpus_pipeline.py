"""From raw documents to token ids: five stages, each over all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` stores it as Parquet in the
shared folder and reads it back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe_frame import encode_texts, tokenizer_text
from llm.decontamination import contamination
from llm.language_id import UNKNOWN, learn, predict_languages
from llm.near_dedup import near_duplicates
from llm.shipping import shipped
from llm.substring_dedup import WINDOW
from llm.suffix_dedup import remove_repeated_bytes
from llm.texts import BLANKS, documents, written

TOKENIZER = "word_bpe_49k.json"
#: Words of a shingle in the near-duplicate stage; op8 alone is bound to four.
SHINGLE = 5


@shipped
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: without text, or without a letter."""
    others = F.struct(*(c for c in docs.columns if c != "text"))
    found = predict_languages(docs.select(others.alias("row"), "text"), learn(docs), keep=("row", "text"))
    return found.where(F.col("lang_pred") != UNKNOWN).select("row.*", "text").select(*docs.columns)


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each component; repeated rows of it count once. Rows without an id stay."""
    verdict = near_duplicates(docs, size=SHINGLE).where("kept and doc_id is not null").select("doc_id").distinct()
    known = docs.alias("d").join(verdict.alias("v"), F.col("d.doc_id") == F.col("v.doc_id"), "left_semi")
    rows = known.select(F.struct("*").alias("row"), "doc_id", F.md5("text").alias("digest"))
    once = rows.dropDuplicates(["doc_id", "digest"]).select("row.*")
    return once.unionByName(docs.where("doc_id is null"))


@shipped
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out of the texts byte strings that repeat (op3's), and word sequences that a smaller doc_id has too (op7's).

    A passage of 50 words is often shorter than 400 bytes. What is left of a cut character goes too, as do emptied documents.
    """
    others = F.struct(*(c for c in docs.columns if c != "text")).alias("others")
    rows = docs.select("doc_id", "text", others, F.col("text").isNull().alias("none"))
    done = remove_repeated_bytes(rows, keep=("others", "none"), words=WINDOW)
    cut, whole = F.col("n_removed") > 0, F.col("kept").cast("string")
    left = F.regexp_replace(F.make_valid_utf8(whole), "�", "")
    columns = {c: F.col("others")[c] if c != "text" else F.when(cut, left).when(~F.col("none"), whole) for c in docs.columns}
    if "n_chars" in columns:
        size = F.length(left).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(cut, size).otherwise(columns["n_chars"])
    stays = done.where(~cut | (F.btrim(left, F.lit(BLANKS)) != ""))
    return stays.select(*(column.alias(c) for c, column in columns.items()))


@shipped
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap with a benchmark item."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select("doc_id").distinct()
    return docs.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left_anti")


@shipped
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit) and the SHA-256 of their decoded text."""
    found = encode_texts(docs, tokenizer_text(public_tokenizers.path(TOKENIZER)))
    return found.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SQL expresses none of the stages but the first; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
