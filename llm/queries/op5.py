from pyspark.sql import functions as F

from llm.texts import documents, learns
from llm.toxicity import THRESHOLD, learn, score_texts


def toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = score_texts(docs, *learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = (~learns(F.col("doc_id"), 3, 1)).alias("held_out")
    return found.select("doc_id", held, "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op5_toxicity": toxicity}
