"""A pipeline from raw documents to packed sequences; each stage is one operator of auditmill.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditmill.llm import stages
from auditmill.llm.common import written

STAGES = stages.STAGES
#: Learned scores, suffix arrays and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the whole documents table; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
