"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit.

Documents are aggregated by encoded length, so what is shuffled and kept has a row per distinct length. For a
limit c, the tokens that remain after cutting every document to c are (tokens of documents shorter than c) +
c * (documents of at least c); both come from sums over the histogram. Sums are taken in two levels, over blocks of
lengths and inside each block, so no task holds the whole histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskflow.llm import common
from deskflow.llm.tokenizing import ByteEncoder, byte_bpe_path

BLOCK = 512  # lengths of one block


def token_lengths(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_tokens) of every row; a null text is empty and has 0 tokens.

    Texts of any length are encoded whole. Rows that repeat an id, or have none, all come back. An empty table gives no
    rows; other columns are not read.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        coder = ByteEncoder.at(path)
        for batch in batches:
            for part in common.slices(batch, "body"):
                width = coder.dtype.itemsize
                n = [len(ids) // width for ids in coder.encode([t or "" for t in part.column("body").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("ident"), pa.array(n, pa.int64())], names=[ident, "n_tokens"])

    kind = dict(docs.dtypes)[ident]
    return docs.selectExpr(f"`{ident}` as ident", f"`{text}` as body").mapInArrow(run, f"`{ident}` {kind}, n_tokens long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row per distinct length, as (n_tokens, n_docs, tokens_at, docs_at_least, tokens_at_least, rank, kept_at_limit).

    ``docs_at_least`` and ``tokens_at_least`` are suffix sums; ``rank`` is the share of documents no longer than this;
    ``kept_at_limit`` is the tokens left if every document is cut to this length. An empty table gives no rows.
    """
    rows = lengths.groupBy(F.col(column).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    rows = rows.withColumn("tokens_at", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    rows = common.materialise(rows, "lengths")  # read twice below; a row per distinct length
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens_at").alias("block_tokens"))
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(everything).alias("all_docs"),
        F.sum("block_tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        rows.withColumn("docs_in", F.sum("n_docs").over(inside))
        .withColumn("tokens_in", F.sum("tokens_at").over(inside))
        .join(blocks, "block")
        .withColumn("docs_at_least", F.col("docs_in") + F.col("docs_above"))
        .withColumn("tokens_at_least", F.col("tokens_in") + F.col("tokens_above"))
    )
    return summed.select(
        "n_tokens",
        "n_docs",
        "tokens_at",
        "docs_at_least",
        "tokens_at_least",
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("rank"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("kept_at_limit"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """(limit, total_docs, total_tokens, truncated_tokens, docs_cut) for any limit, from the histogram alone."""
    n, docs = F.col("n_tokens"), F.col("n_docs")
    return histogram.agg(
        F.lit(limit).cast("long").alias("limit"),
        F.coalesce(F.sum(docs), F.lit(0)).alias("total_docs"),
        F.coalesce(F.sum(n * docs), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.least(n, F.lit(limit)) * docs), F.lit(0)).alias("truncated_tokens"),
        F.coalesce(F.sum(F.when(n > limit, docs)), F.lit(0)).alias("docs_cut"),
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of documents does not exceed."""
    return histogram.where(F.col("rank") >= share).agg(F.lit(share).alias("share"), F.min("n_tokens").alias("n_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(common.documents(spark, sf_dir), byte_bpe_path()))
