from llm.suffix_dedup import remove_repeated_bytes
from llm.texts import documents


def suffixes(spark, sf_dir):
    return remove_repeated_bytes(documents(spark, sf_dir))


QUERIES = {"op3_suffix_dedup": suffixes}
