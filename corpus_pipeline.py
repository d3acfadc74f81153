"""From raw documents to packed sequences: each stage's table is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.mixing import mix_stage
from graphloom.llm.neardup import dedup_stage
from graphloom.llm.packing import pack_stage
from graphloom.llm.quality import quality_stage
from graphloom.llm.secrets import mask_stage
from graphloom.llm.store import table, written

STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", dedup_stage),
    ("secret scan", mask_stage),
    ("source mixing", mix_stage),
    ("packing", pack_stage),
]

#: The classifier's perplexities and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
