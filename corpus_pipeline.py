"""The corpus pipeline: quality filter, exact and near deduplication, mixing, token counts.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a
DataFrame. All but the last return the columns of ``documents``; ``run`` writes each stage as
Parquet in the shared folder, reads it again for the next and removes it once that is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, mixing, pieces, quality, shingle_sets
from plumbline.llm.common import bucket_of, remove, shared_path
from plumbline.llm.queries import PIECE_MODEL


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects. It learns from four fifths of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(bucket_of("doc_id", 5) != 0)
    return quality.only_good(docs, quality.fit_quality(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of texts that are equal but for white space."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document of the smallest id of each component of texts whose five-word shingles are 0.8 alike or more.

    Proposed by bands, compared by SimHash bit planes, decided on whole shingle sets.
    """
    return shingle_sets.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins documents towards the target weight of their source, in shuffled order."""
    return mixing.mixed(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as count and digests."""
    return pieces.encode_texts(docs, public_tokenizers.path(PIECE_MODEL), keep=("doc_id", "source"), digests=True)


STAGES = [("quality", keep_good), ("exact", drop_copies), ("near", drop_near_copies), ("mix", mix), ("tokens", tokens)]

#: SQL expresses neither the classifier nor the near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
