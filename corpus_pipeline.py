"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
other columns there are. Stages are written as Parquet to the shared folder and read again, so that a lost executor costs
at most the stage's own work.

Defined cases: null and empty texts pass toxicity, decontamination and secrets as they are, and are one group of
near-duplicates, of which the row with the smallest id stays (null ids last); very long texts are taken whole; of
repeated rows one stays; an empty table gives no pieces; secrets become [SECRET], and n_chars follows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import decontam, near_copies, packing, secrets, toxicity
from folioflow.llm.common import remove, shared_dir, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: groups by SimHash and by a similarity of 0.8 or more, of five words."""
    return near_copies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark window go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays."""
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and the sequences they are packed into."""
    return packing.pack(packing.cut(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # stages rest on trained weights, hashes and a tokenizer; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that packing gives. A stage's folder goes when the stage after it is written; packing keeps its own pieces."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline/{uuid.uuid4()}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)
    return packed
