"""A training corpus from raw documents: language, toxicity, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
rereads it as the next stage's documents. All stages but the last return the columns of ``documents``. Null texts have
no language and go in the first stage; repeated rows are exact copies and one of them stays; extra columns stay.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from joulegrid.llm.common import read_table
from joulegrid.llm.langid import keep_identified
from joulegrid.llm.near_copies import keep_one_of_each
from joulegrid.llm.packing import pack
from joulegrid.llm.privacy import redact
from joulegrid.llm.toxicity import keep_clean
from joulegrid.shared import new_folder, remove


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is less likely than all others together, go."""
    return keep_identified(docs, 0.5)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    return keep_clean(docs, read_table(spark, sf_dir, "labels"), 0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 of their five-word shingle sets, the least id stays."""
    return keep_one_of_each(docs, 26, 5, Fraction(4, 5))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text gives way to the kind of it."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL has neither the models nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
