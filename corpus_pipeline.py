"""The corpus pipeline: from raw documents to token digests of a deduplicated, weighted mix.

Each stage takes all its predecessor kept, with the columns of ``documents``; run() writes each stage's result to
the shared folder as Parquet and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidgraph.llm import exact, minhash, mixing, pieces, quality
from braidgraph.llm.common import discard, small_batches, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer takes for clean."""
    small_batches(spark)
    return quality.clean(docs, quality.trained(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the smallest doc_id."""
    small_batches(spark)
    return exact.survivors(docs, exact.exact_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity of 0.8): the smallest doc_id."""
    small_batches(spark)
    return minhash.survivors(docs, minhash.near_duplicates(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often, and as much of them, as their source's target takes."""
    small_batches(spark)
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every row of the mix."""
    small_batches(spark)
    return pieces.tokenized(docs, pieces.model_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: No SQL: training, sketches and subword merges can't be told in it; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
        if before is not None:
            discard(before)
        before = docs
    return docs
