"""Corpus preparation: documents pass the stages in order; each reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terravane.llm.line_dedup import line_stage
from terravane.llm.minhash import minhash_stage
from terravane.llm.packing import packing_stage
from terravane.llm.pii import pii_stage
from terravane.llm.quality_rules import quality_stage
from terravane.session import materialize

STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", minhash_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: Trained rules and spans, and tokenization, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
