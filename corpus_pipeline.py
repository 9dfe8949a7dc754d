"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and reread as the next one's input. The stages' code and defined results are in
``souk.llm.pipeline``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk.llm.common import staged
from souk.llm.pipeline import STAGES

# The learned scores of the first stage have no SQL form; tests hold each
# stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
