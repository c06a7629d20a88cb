"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept. All but the
last return the columns of ``documents``; the last returns pieces with their ids and places. The
stages' rules are iterative or learned, which SQL cannot express, so there is no SQL for the rows;
``tests/llm`` compares every stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, language, lines, neardup, packing
from graphloom.llm.common import materialize

STAGES = [
    ("language_id", language.stage),
    ("line_dedup", lines.stage),
    ("near_dedup", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("best_fit_packing", packing.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
