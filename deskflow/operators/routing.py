"""Reply correlation: each finished turn takes the newest pending message of its agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending_replies(events: DataFrame, agent: str, order: list[str], ident: str, inbound: Column, end: Column) -> DataFrame:
    """(agent, inbound_id, end_id) for every turn end that finds a message pending.

    An agent has one slot. An inbound message overwrites it and an end takes and clears it, so between two ends only
    the newest message counts: rows are numbered by the ends before them, and each number is one aggregated group.
    """
    before = Window.partitionBy(agent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.where(inbound | end).select(agent, F.struct(*order).alias("at"), F.col(ident).alias("ident"), inbound.alias("is_in"), end.alias("is_end"), F.coalesce(F.sum(end.cast("long")).over(before), F.lit(0)).alias("epoch"))
    slots = rows.groupBy(agent, "epoch").agg(F.max_by(F.when(F.col("is_in"), F.col("ident")), F.when(F.col("is_in"), F.col("at"))).alias("inbound_id"), F.max(F.when(F.col("is_end"), F.col("ident"))).alias("end_id"))
    return slots.where("inbound_id is not null and end_id is not null").select(agent, "inbound_id", "end_id")
