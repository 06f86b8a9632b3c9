"""The corpus pipeline: five stages from raw documents to sampled encodings.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next stage's docs. All but the last return the columns of docs.
Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns are
handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairweave.llm.mixing import mix_documents, training_order
from pairweave.llm.neardup import keep_one_of_each
from pairweave.llm.pii import masked
from pairweave.llm.quality import keep_selected
from pairweave.llm.segment import encode
from pairweave.plans.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; the rest go."""
    return keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles at similarity 0.8 or more."""
    return keep_one_of_each(docs, k=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return masked(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, document by document in training order, repeats included."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, file and row, whose order is the training order, and the sampled segmentations of every document of the mix.

    Rows repeat where the mix repeats a document; each has its own place and equal samples.
    """
    return encode(training_order(docs), keep=("file", "row"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Near duplicates, the trained tagger and sampling are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        written = scratch.table(out)
        scratch.drop(docs)
        docs = written
    return docs
