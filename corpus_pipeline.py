"""The corpus pipeline: five stages over ``documents``, each on what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a table, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.

Every stage takes null and empty texts, null and repeated keys, repeated rows and
further columns; an empty table gives an empty one. A null text is not toxic, has
no lines, shares the fingerprint of empty texts, has no words and no tokens. Rows
that share a key count as one document for line dedup, those without one as many
as they have different texts; near dedup leaves one row of each group; the mix
takes each remaining row for itself.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import bpe, lines, mixing, simhash, toxicity
from tallywright.llm.common import delete, scratch, shared_folder

#: SQL can express neither the classifier nor the similarity stages.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), output="__toxicity")
    return scored.filter(F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near-repeated lines; ``n_chars`` follows the text."""
    return lines.deduplicated(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.deduplicated(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the target mix, each as often as it is taken."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and number of tokens."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("byte-level bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written below the shared checkpoint folder.

    What a stage wrote on its way goes when its result is written, and each
    result when the next one is; the last one stays.
    """
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}")
        if place:
            delete(spark, f"{folder}/{place - 1}")
        docs = spark.read.parquet(f"{folder}/{place}")
    return docs
