"""Exact deduplication: group by a 128-bit content hash, compare bytes inside the groups, keep one row of each.

DataFrame functions only. The texts meet once, in a hash aggregation keyed by (hash, normalised text): Spark
compares the key's bytes, so a collision of the hash makes two classes, and copies are combined before the
shuffle, so a group that holds a third of all rows sends one row per task. Labels go back to the documents by a
narrow join whose skewed keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskflow.llm import common

SPACE = r"[\x20\x09-\x0D]+"
_TOP = "9223372036854775808"


def _rank(points: Column, ident: Column) -> Column:
    """One decimal, greatest for the most code points, then the smallest id; a null id comes after all others."""
    behind = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - ident.cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)"))
    return (points.cast("decimal(12,0)") * F.lit("1" + "0" * 20).cast("decimal(21,0)") + behind).cast("decimal(38,0)")


def _ident(rank: Column) -> Column:
    behind = rank % F.lit("1" + "0" * 20).cast("decimal(21,0)")
    return F.when(behind > 0, (F.lit(_TOP).cast("decimal(20,0)") - behind).cast("long"))


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def exact_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Label every row with its class of equal texts.

    Returns (ident, keep_id, group_size, kept, text_sha256), one row per input row. A null text counts as empty;
    empty texts equal each other. Rows that repeat an id and a text are all labelled alike. A row whose id is null
    stays only if no row of its class has an id; keep_id is then null. An empty table gives an empty result. Other
    columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(ident).alias("ident"), F.col(text).alias("body"))
    body = rows.select(
        "ident", F.length(F.coalesce("body", F.lit(""))).alias("points"), normal(F.col("body")).alias("norm")
    ).withColumn("h", F.unhex(F.md5("norm")))
    classes = (
        body.groupBy("h", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(_rank(F.col("points"), F.col("ident"))).alias("best"))
        .select("h", F.sha2("norm", 256).alias("sha"), "group_size", _ident(F.col("best")).alias("keep_id"))
    )
    marks = body.select(F.col("ident"), F.col("h"), F.sha2("norm", 256).alias("sha"))
    return marks.join(classes, ["h", "sha"]).select(
        F.col("ident").alias(ident), "keep_id", "group_size", F.col("ident").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, one for each class of equal texts, with all their columns."""
    best = common.materialise(exact_dedup(docs, ident, text).where("kept").select(F.col(ident).alias("__kept_id"), F.col("text_sha256").alias("__kept_sha")), "kept")
    hashed = docs.withColumn("__sha", F.sha2(normal(F.col(text)), 256))  # ids may be null or repeat: they don't tell classes apart
    same = hashed.join(best, F.col(ident).eqNullSafe(F.col("__kept_id")) & (F.col("__sha") == F.col("__kept_sha")), "left_semi")
    repeated = best.groupBy("__kept_id", "__kept_sha").count().where("count > 1").limit(1).take(1)
    return (same.dropDuplicates([ident, "__sha"]) if repeated else same).drop("__sha")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
