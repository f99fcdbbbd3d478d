from llm.near_dedup import near_duplicates
from llm.texts import documents


def near(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op8_near_dedup": near}
