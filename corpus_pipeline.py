"""A corpus pipeline: language ID, exact dedup, n-gram Jaccard join, mixing to target weights, BPE.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of ``documents``; the last returns each taken copy's token ids with their digests. Stages on word n-grams take
five words and a similarity of 0.8.

What every stage does with awkward rows: a null text counts as empty and goes in the first stage, as does one without a
letter; texts of any length are read whole; rows that repeat an id and a text are copies and become one in the second
stage; rows that repeat an id with different texts share the fate of the one that stands for the id in the third; rows
without an id are documents of their own and never near copies; columns beyond those of ``documents`` are carried on,
whatever their names; an empty table gives no rows. What a stage wrote is deleted when the next one has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskflow.llm import bpe, common, exact_dedup, language_id, mixing, ngram_join
from deskflow.session import ship


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: null texts, texts without a letter, texts whose n-grams no language has."""
    ship(spark)
    return language_id.keep_known(docs, least=0.0)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts stays: the longest, then the one with the least id."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.8 stays: the one with the least id."""
    ship(spark)
    return ngram_join.keep_one(docs, words=5, share=(80, 100))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take_copies(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row."""
    ship(spark)
    coded = bpe.encode_texts(docs, bpe.word_bpe_path(), decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL can't express the learned filters of the first stage or BPE merges; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table of documents; each result is written as Parquet and read back."""
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if docs is not first:
            common.discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
