"""A training corpus in five stages: toxic documents go, near copies go, repeated passages and secrets are cut, ids are packed.

Each stage takes what the one before kept, works on all of it and is written as Parquet and read again, so that a lost
executor costs no more than a part of one stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilelake.llm.common import drop_staged, stage, staging
from tilelake.llm.ngram_join import stage_near_copies
from tilelake.llm.packing import stage_packing
from tilelake.llm.secrets import stage_secrets
from tilelake.llm.substring_dedup import stage_substrings
from tilelake.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("ngram_join", stage_near_copies),
    ("substring_dedup", stage_substrings),
    ("secret_scan", stage_secrets),
    ("packing", stage_packing),
]

#: A trained classifier and token ids are beyond SQL: the pipeline is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, function in STAGES:
        with staging() as keep:
            docs = keep(stage(function(spark, docs, sf_dir)))
        if before is not None:
            drop_staged(before)
        before = docs
    return docs
