"""Stored memories: ranked bounded recall, point lookup, upsert view and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskflow.functions import text as T
from deskflow.operators.messages import limit_of

# Default and greatest number of hits; how long memories are meant to last, from least to most.
RECALL_DEFAULT, RECALL_MOST = 5, 25
DURABILITY = ("ephemeral", "standard", "persistent", "permanent")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def recall(vectors: DataFrame, query: DataFrame, limit: int | None = None, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(ident, score): the best hits for one query vector (a table of one row), ties by id; more rows are an error.

    The query is one row, so joining it to all vectors is a broadcast of one row; the top rows are kept per task.
    """
    two = query.select(F.col(vector).alias("q")).limit(2).agg(F.collect_list(F.struct("q")).alias("rows"))
    found = F.when(F.size("rows") > 1, F.raise_error(F.lit("recall takes one query vector"))).otherwise(F.col("rows"))
    one = two.select(F.inline(found))
    scored = vectors.join(F.broadcast(one)).select(ident, F.round(cosine(F.col(vector), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), ident).limit(limit_of(limit, RECALL_DEFAULT, RECALL_MOST))


def hits(results: DataFrame) -> DataFrame:
    """Search results of any shape as (id, content, createdAt, score): missing ids become empty, scores must be numbers."""
    return results.select(F.coalesce("id", F.lit("")).alias("id"), F.coalesce("content", F.lit("")).alias("content"), "createdAt", F.expr("try_cast(score AS double)").alias("score"))


def render_hits(rows: DataFrame) -> DataFrame:
    """One row: ``[score] date id: content`` lines of (id, content, createdAt, score), best first, bounded."""
    line = F.concat(F.lit("["), T.fixed3(F.col("score")), F.lit("] "), T.date_prefix(F.col("createdAt")), F.lit(" "), F.col("id"), F.lit(": "), F.col("content"))
    lines = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda l: l["line"]), "\n")
    return lines.select(T.bounded(F.when(F.size("lines") > 0, text).otherwise("(no memories found)"), T.RECALL_LIMIT).alias("rendered"))


def get(memories: DataFrame, ids: DataFrame, ident: str, content: str) -> DataFrame:
    """(ident, content) of wanted ids, ``(not found)`` where there is none."""
    return ids.join(memories.select(ident, content), ident, "left").select(ident, F.coalesce(content, F.lit("(not found)")).alias(content))


def latest(writes: DataFrame, ident: str, order: str) -> DataFrame:
    """The upsert view of an append-only table: the last write of each id; of several at once the greatest row."""
    rest = [c for c in writes.columns if c != ident]
    last = F.max(F.struct(order, *[c for c in rest if c != order]))
    return writes.groupBy(ident).agg(last.alias("row")).select(ident, *[F.col(f"row.`{c}`").alias(c) for c in rest])


def new_memory(rows: DataFrame) -> DataFrame:
    """(agentId, ms, content, durability, supersedes) as rows to append; durability is standard by default."""
    return rows.select(T.memory_id(F.col("agentId"), F.col("ms")).alias("id"), "agentId", "content", F.coalesce("durability", F.lit("standard")).alias("durability"), T.iso_millis(F.col("ms")).alias("createdAt"), "supersedes")
