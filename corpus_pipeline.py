"""From raw documents to packed training sequences, in named stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import shared_dir
from quire.llm.mixing import mix_stage
from quire.llm.neardup import near_duplicate_stage
from quire.llm.packing import pack_stage
from quire.llm.suffix import suffix_stage
from quire.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", suffix_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

# Learned scores, sketches and tokenizers can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet in the
    shared folder and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
