"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from vigil.operators.graph import remove, shared_folder

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("mixing", mixing.stage),
    ("bpe_encoding", bpe.stage),
]

#: Segment search, MinHash and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = os.path.join(shared_folder(spark), "vigil", f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:  # what the stage before wrote is not read again
            remove(docs)
        docs = spark.read.parquet(path)
    return docs
