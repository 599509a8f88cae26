"""A training-data pipeline: toxic documents go, boilerplate lines go, one of each group of near copies stays, sources
are mixed to target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Every stage takes an empty table
and gives one. Null and empty texts are kept by the classifier unless the offset alone is toxic, have no lines, are one
group of near copies, stay in the mix with size 0, and encode to no ids. Of equal rows that near-copy
removal would keep, one is taken; ids stay as they are, null ones and ones beyond 2^53 too. SQL can't express the
classifier, the fingerprints or the merges, so there is no SQL for the whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe, line_dedup, mixing, simhash, toxicity
from cadenza.llm.components import checkpoint_dir, delete_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactual-regularised classifier doesn't predict toxic."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites have and an earlier document keeps."""
    told = line_dedup.without_spread_lines(docs.select(*COLUMNS))
    return told.withColumn("n_chars", F.when(F.size("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: groups of SimHash fingerprints by pigeonhole search, MinHash buckets
    beside them, and a link confirmed by the texts' shingles."""
    return simhash.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and digests of them and of the text they decode to."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_spread_lines),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the shared folder and read again; the stage before it
    is deleted as soon as that is done, so the last stage's table alone stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete_folder(spark, before)
        before = path
    return docs
