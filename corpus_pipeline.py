"""A training corpus from `documents`: good, distinct, without personal data, mixed and encoded.

Every stage takes (spark, docs, sf_dir); ``run`` and the check tool write each stage's result as Parquet and
read it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm import mixing, ngram_join, pieces, pii, quality
from strandweave.llm.queries import PII_KEY, vocabulary
from strandweave.llm.storage import Workspace


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, trained on `labels`, does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id."""
    return ngram_join.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data and secrets replaced by surrogates, and n_chars to match."""
    return pii.replace_entities(docs, PII_KEY)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents repeated to the target weights of their sources, in a global random order."""
    return mixing.mix(docs).drop("replica", "shuffle_key")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the piece ids of each document.

    Copies of a document are numbered, in any order as they are alike, and cut independently.
    """
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    docs = docs.withColumn("replica", F.row_number().over(copies))
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"), replica_col="replica").select("doc_id", "source", "ids")


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("PII surrogates", without_personal_data),
    ("mixing", mixed_sources),
    ("piece encoding", encoded),
]

#: The classifier, the keyed surrogates and the encoder are beyond SQL; tests compare the stages by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), f"stage-{i}")
        work.keep(f"stage-{i}")  # what it was made of is not read again
    return docs
