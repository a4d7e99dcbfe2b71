"""Corpus pipeline: from raw documents to packed training sequences, a stage at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.common import discard, tidied
from quantloom.llm.mixing import mix_stage
from quantloom.llm.near_dedup import near_dedup_stage
from quantloom.llm.packing import packing_stage
from quantloom.llm.suffix_dedup import suffix_dedup_stage
from quantloom.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("mixture", mix_stage),
    ("best_fit_packing", packing_stage),
]
#: The classifier, the signatures and the draw of the mix have no SQL form; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written to the shared folder and read by the next, which then
    deletes them and what else it wrote there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = tidied(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
