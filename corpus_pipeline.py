"""A training-data pipeline: language ID, near-dedup, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir), works on everything that the one before it kept, and is written to the shared
folder and read again before the next, so a lost executor never costs more than one stage. All but the last return the
columns of documents, whatever else these have. What a stage wrote on the way is removed once its result stands. Nulls,
empty texts, rows without an id and repeated rows are treated as each stage says; an empty table gives no rows.
"""

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language_id, near_dedup, packing, pii
from tessera.llm.shared import WRITTEN, remove, written

STAGES = [
    ("language_id", language_id.stage),
    ("near_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]
#: Suffix automata, alignments and a trained network have no counterpart in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = len(WRITTEN)
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove(spark, WRITTEN[before:-1])
        if name != STAGES[0][0]:
            remove(spark, [WRITTEN[before - 1]])  # the stage before
        docs = kept
    return docs
