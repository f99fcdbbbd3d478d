from pyspark.sql import functions as F

from llm.language_id import learn, predict_languages
from llm.texts import documents, learns


def language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = predict_languages(docs, learn(docs))
    return found.select("doc_id", (~learns(F.col("doc_id"), 5, 0)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": language}
