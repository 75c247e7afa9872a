"""A corpus pipeline of the operators in strandloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import best_fit, decontamination, ngram_join, pii, quality_rules
from strandloom.llm._store import stored

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_duplicates", ngram_join.stage),
    ("decontamination", decontamination.stage),
    ("pii", pii.stage),
    ("best_fit_packing", best_fit.stage),
]

#: The last stage's tokenizer can't be expressed in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
