from llm.quality_rules import quality_rules
from llm.texts import documents


def quality(spark, sf_dir):
    """Base signals of every document and the verdict of the certified cutoffs."""
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op10_quality_rules": quality}
