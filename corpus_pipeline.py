"""A corpus through five stages: good, not toxic, once each, not in the benchmark, packed."""

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import decontam, packing, quality, simhash, toxicity
from kindred.llm.common import cut, table

STAGES = [
    ("quality", quality.stage),
    ("toxicity", toxicity.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontam.stage),
    ("packing", packing.stage),
]

#: SQL expresses neither the fitted models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
