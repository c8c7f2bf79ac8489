"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

1. Language ID: documents without a confident language go.
2. N-gram Jaccard join: one document of each group of near copies stays, that with the least doc_id.
3. Suffix dedup: bytes of 50-byte strings that an earlier document has are cut out of the texts.
4. Secret scans: every found span is replaced by a mark.
5. Packing along a Hilbert curve into sequences of 2048 tokens.

Stages 1 to 4 return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import common, jaccard, language, packing, queries, secrets, suffix


def _stage(f):
    """A stage whose own tables go when the next stage begins: by then its result has been written."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, "pipeline", unless=docs)
        with common.scope("pipeline"):
            return f(spark, docs, sf_dir)

    return run


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.train(docs))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(docs)


@_stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs).withColumn("n_chars", F.char_length("text").cast("long"))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix dedup", cut_repeats),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained model nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with common.scope(f"pipeline input {k}"):
                docs = common.materialize(docs, f"stage{k}")
            common.release(spark, f"pipeline input {k - 1}")
    return docs
