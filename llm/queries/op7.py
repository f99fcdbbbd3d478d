from llm.substring_dedup import remove_repeats
from llm.texts import documents


def substrings(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))


QUERIES = {"op7_substring_dedup": substrings}
