from llm.decontamination import contamination
from llm.texts import documents


def decontamination(spark, sf_dir):
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op4_decontamination": decontamination}
