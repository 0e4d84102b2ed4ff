"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share a total; none exceeds a
multiple of its own size, and what is over goes to the others by weight (water filling, in closed form over the
table of sources). Copies: with r = target / source size, every document is taken floor(r) times whole; the rest of
the target is a sample without replacement, with probabilities of inclusion in proportion to size: p = min(1, l * size),
where l makes the expected words equal to the rest. Documents are ranked by the odds of a fixed random number divided
by the odds of p, and taken in that order until their words come nearest to the rest.

No task sees a whole source: ranked documents are range-partitioned by (source, quotient), which cuts a source of any
size into even stretches; words are summed inside each stretch, and the sums of stretches, a row each, are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskflow.llm import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def uniform(ident: Column, seed: int) -> Column:
    """A fixed number in (0, 1) for an id, from 52 bits of an MD5 sum."""
    digest = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs) to the same with ``target``; the table has a row per source, not per document."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(choices, (F.row_number().over(order) - 1) % len(weights) + 1))
    whole = Window.partitionBy()
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("wanted", F.sum("source_size").over(whole) * F.lit(float(share)))
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("wanted") - F.col("capped")) / (F.sum("weight").over(whole) - F.col("used")))
    # The level of the first source that it doesn't fill holds for all after it.
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("capped", "level"))).over(whole)["level"])
    return rows.select("source", "source_size", "n_docs", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def inclusion(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(of, level, certain): p = min(1, level * size), and documents of ``certain`` words or more are certain.

    sized: (source, size); plan: (of, rest). If the k largest documents are certain, the others share what these leave,
    in proportion to size; k is the least for which no other document would exceed certainty. Works on counts by
    source and size, whose rows are bounded by the lengths that texts can have, not by the documents.
    """
    counts = sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("m"))
    rows = counts.join(plan.select("of", "rest"), F.col("source").eqNullSafe(F.col("of")))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    words, squares = F.col("m") * F.col("size"), (F.col("m") * F.col("size") * F.col("size")).cast("decimal(38,0)")
    rows = rows.withColumn("over", F.coalesce(F.sum(words).over(above), F.lit(0))).withColumn("below", F.sum(squares).over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double"))
    rows = rows.withColumn("level", (F.col("rest") - F.col("over")) / F.col("below"))
    # From the longest size down, the first that its level doesn't make certain fixes the level of all below.
    return rows.where(F.col("level") * F.col("size") < 1).groupBy("of").agg(F.max(F.struct("size", "level"))["level"].alias("level"))


def mix_sources(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, more: Column | None = None
) -> DataFrame:
    """Return (ident, size, source_size, target, taken, copies), one row per input row, and ``more`` if it is given.

    A null text has size 0; a null source is a source of its own, the last. Rows that repeat an id share its random
    number and are ordered by size. Texts of any length are counted whole. Empty tables give empty results; other
    columns, whatever their names, are not read. Ids and sizes are written to the shared folder, so texts are read once.
    The table of sources, a row per source, is written too; Spark broadcasts it only below its own limit of size. One
    task computes the targets from it, so sources must be some millions at most; documents may be any number.
    """
    common.ship(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    extra = F.lit(None).cast("binary") if more is None else more
    narrow = common.materialise(docs.select(F.col(ident).alias("ident"), F.col(source).alias("source"), size.alias("size"), extra.alias("more")), "mix")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = targets(sizes, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))).withColumnRenamed("source", "of")
    plan = common.materialise(plan.select("of", "source_size", "target", "whole", "rest"), "plan")
    levels = inclusion(narrow.select("source", "size"), plan).withColumnRenamed("of", "level_of")
    plan = common.materialise(plan.join(levels, F.col("of").eqNullSafe(F.col("level_of")), "left").drop("level_of"), "plan")
    p = F.least(F.coalesce(F.col("level"), F.lit(1.0)) * F.col("size"), F.lit(1.0))
    odds = F.col("u") / (1 - F.col("u"))
    # An empty text has no chance and no words: it comes last. A certain one has quotient 0.
    quotient = F.when(F.col("p") > 0, odds * ((1 - F.col("p")) / F.col("p"))).otherwise(F.lit(float("inf")))
    ranked = narrow.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("u", uniform(F.col("ident"), seed)).withColumn("p", p).withColumn("q", quotient)
    order = [F.col("of").asc_nulls_last(), F.col("q"), F.col("u"), F.col("ident"), F.col("size"), F.col("more")]
    dealt = ranked.select("ident", "size", "more", "of", "q", "u").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        part, last, words = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            names = batch.column("of").to_pylist()
            upto = np.cumsum(batch.column("size").to_numpy())
            before = upto - batch.column("size").to_numpy()
            starts = [i for i, name in enumerate(names) if (name,) != ((names[i - 1],) if i else last)]
            out = before + words
            for i in starts:
                out[i:] = before[i:] - before[i]
            last, words = (names[-1],), int(out[-1] + upto[-1] - before[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out), pa.array(np.full(len(out), part, np.int32))], names=["ident", "size", "more", "of", "inside", "part"])

    kinds = dict(ranked.dtypes)
    summed = common.materialise(dealt.drop("q", "u").mapInArrow(run, f"ident {kinds['ident']}, size long, more {kinds['more']}, of {kinds['of']}, inside long, part int"), "ranked")
    # A stretch is what a task has of a source: at most as many as tasks and sources together.
    stretches = summed.groupBy("of", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(F.col("of").alias("in_of"), F.col("part").alias("in_part"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    stretches = common.materialise(stretches, "stretches")
    placed = summed.join(stretches, F.col("of").eqNullSafe(F.col("in_of")) & (F.col("part") == F.col("in_part")))
    placed = placed.join(plan.select(F.col("of").alias("plan_of"), "source_size", "target", "whole", "rest"), F.col("of").eqNullSafe(F.col("plan_of")))
    once = (F.col("rest") > 0) & (F.col("before") + F.col("inside") + F.col("size") / 2 <= F.col("rest"))
    both = placed.withColumn("copies", F.col("whole") + once.cast("long"))
    columns = [F.col("ident").alias(ident), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"]
    return both.select(*columns, *([] if more is None else ["more"]))


def take_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as it has copies, with all their columns.

    Rows are told apart by id, source and text. Of rows that repeat all three the copies are added up and dealt to one.
    """
    digest = F.unhex(F.md5(F.coalesce(text, F.lit(""))))
    taken = mix_sources(docs, ident, text, source, more=F.struct(F.col(source).alias("source"), digest.alias("digest")), **options)
    copies = taken.groupBy(F.col(ident).alias("id"), F.col("more.source").alias("source"), F.col("more.digest").alias("digest")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    copies = common.materialise(copies, "copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest.alias("digest"))
    if copies.where("rows > 1").limit(1).take(1):
        rows = rows.groupBy(F.col(f"row.`{ident}`").alias("id"), F.col(f"row.`{source}`").alias("source"), "digest").agg(F.first("row").alias("row")).select("row", "digest")
    keep = copies.where("copies > 0").select("id", "source", F.col("digest").alias("of"), "copies")
    same = F.col(f"row.`{ident}`").eqNullSafe(F.col("id")) & F.col(f"row.`{source}`").eqNullSafe(F.col("source")) & (F.col("digest") == F.col("of"))
    return rows.join(keep, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(common.documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':7'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS wanted, sum(weight) OVER () AS weights FROM s
), f AS (
  SELECT *, coalesce(sum(cap) OVER w, 0.0::DOUBLE) AS capped, coalesce(sum(weight) OVER w, 0.0::DOUBLE) AS used
  FROM c WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min((wanted - capped) / (weights - used), capped) AS level
  FROM f WHERE (wanted - capped) / (weights - used) * weight <= cap
), t AS (
  SELECT source, source_size, least(coalesce(level * weight, cap), cap) AS target FROM f, l
), r AS (
  SELECT *, greatest(target - whole * source_size, 0.0::DOUBLE) AS rest FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t)
), k AS (
  SELECT d.source, d.size, r.rest, count(*) AS m FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source WHERE d.size > 0 GROUP BY ALL
), v AS (
  SELECT source, size, (rest - coalesce(sum(m * size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(m * size * size) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM k WINDOW w AS (PARTITION BY source ORDER BY size DESC)
), y AS (
  SELECT source, arg_max(level, size) AS level FROM v WHERE level * size < 1 GROUP BY source
), e AS (
  SELECT d.*, r.source_size, r.target, r.whole, r.rest, least(coalesce(y.level, 1.0::DOUBLE) * d.size, 1.0::DOUBLE) AS p
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN y ON d.source IS NOT DISTINCT FROM y.source
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) ELSE 'inf'::DOUBLE END AS q FROM e
), x AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM q
), o AS (
  SELECT *, whole + CASE WHEN rest > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS copies FROM x
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM o
"""
