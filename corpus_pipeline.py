"""The corpus pipeline: five operators in a row, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordprism.llm import decontaminate, ngram_join, quality_gam, source_mix, token_files
from wordprism.session import scratch_path

TOKEN_BATCH = 1 << 19  # ids coded in step; executors still hold what earlier stages left
TOKEN_CACHE = 400_000  # pieces of text that a worker remembers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is fitted on the labelled rows of the incoming documents."""
    return quality_gam.keep_good(docs, quality_gam.train(docs, _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest doc_id.

    Of rows that repeat the smallest doc_id one stays; rows without an id stay.
    """
    groups = ngram_join.similar_groups(docs, 5, 80)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    named = docs.join(first, F.col("doc_id") == F.col("_first"), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; a document that is little else goes whole."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned to the target weights of their sources."""
    return source_mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Coded token files; per document what is read back from them."""
    return token_files.encode_documents(docs, batch_ids=TOKEN_BATCH, cache_chunks=TOKEN_CACHE)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token ids", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
