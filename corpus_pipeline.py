"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage reads what its predecessor wrote and returns the columns of documents;
the last one returns the pieces of the packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from judgelake.llm.decontaminate import drop_contaminated
from judgelake.llm.line_dedup import drop_duplicate_lines
from judgelake.llm.packing import pack_stage
from judgelake.llm.simhash import keep_one_per_group
from judgelake.llm.toxicity import drop_toxic
from judgelake.session import scratch_path

STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_duplicate_lines),
    ("simhash_dedup", keep_one_per_group),
    ("decontamination", drop_contaminated),
    ("packing", pack_stage),
]

#: Trained scores, fingerprints and token ids have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
