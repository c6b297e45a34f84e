"""From raw documents to tokens: quality filter, exact and near deduplication, mixing, encoding.

``run(spark, sf_dir)`` reads ``documents`` and applies the stages in order.  Each stage takes
(spark, docs, sf_dir), works on all that its predecessor kept, and its result is written as
Parquet in the shared folder and read again as the next one's docs.  All but the last return
the columns of ``documents``.

Empty tables pass through every stage; nulls, repeated rows and texts of any length are
treated as the operators' docstrings say; columns beyond those of ``documents`` are carried
to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm import bpe, grace, mixing, near_dedup, quality
from tapeworks.llm.shared import stored


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality model, fitted on these documents, accepts."""
    return quality.scored(docs, quality.fit(docs)).where("accepted").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for blanks, the one with the most code points."""
    return grace.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id."""
    return near_dedup.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed(docs, mixing.plan(mixing.sized(docs)))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; the text is dropped, as the ids decode to it."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.encode(docs, vocabulary, keep=[c for c in docs.columns if c != "text"])


STAGES = [
    ("quality classifier", accept_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("encoding", encode_tokens),
]

#: No SQL states the quality model, the near-duplicate groups or the tokens; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
