"""The corpus pipeline: toxicity, near-duplicates, repeated substrings, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. Each works on all that the stage before it kept.

Defined results of every stage: null and empty texts are kept by toxicity (score 0) and count as one class of near copies,
so that one of them stays; later stages leave them as they are, and packing gives each its end token. Repeated rows are
one class of near copies. Columns of other names pass through all but packing. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from studyloom.llm import decontam, near_copies, packing, substring_dedup, toxicity
from studyloom.llm.common import bounded, passing, shared_path
from studyloom.llm.queries import END_ID, WORD_TOKENIZER
from studyloom.session import ensure_worker_path, table

PASSAGE_WORDS = 51


def _ready(spark: SparkSession) -> None:
    ensure_worker_path(spark)
    bounded(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores at 0.7 or more go; it learns from the labels that aren't held out."""
    _ready(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose five-word shingles are similar by 0.8 or more stays, the one with the
    smallest id."""
    _ready(spark)
    return near_copies.drop_near_copies(docs)


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a repeated string of 400 bytes or a repeated passage of over 50 words covers go."""
    _ready(spark)
    return substring_dedup.drop_repeats(docs, words=PASSAGE_WORDS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words or more go, and documents that mostly consist of them."""
    _ready(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining texts in sequences of at most 4096 tokens."""
    _ready(spark)
    return packing.pack(docs, public_tokenizers.path(WORD_TOKENIZER), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substring dedup", drop_repeated_substrings),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: SQL can't express the network, the fingerprints' components or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. What a stage writes besides its result goes when the result is written, and the
    result when the next stage's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        with passing(spark, before):
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return docs
