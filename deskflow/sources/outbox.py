"""Sinks: replies and reactions as outbox tables, memories as an append-only table, poison as dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskflow.functions import text as T


def replies(rows: DataFrame) -> DataFrame:
    """(channelId, content, reply_to) of (channelId, text, inbound id): bounded, empty ones left out."""
    return rows.where(F.length("text") > 0).select("channelId", T.bounded(F.col("text")).alias("content"), F.col("inbound_id").alias("reply_to"))


def reactions(rows: DataFrame) -> DataFrame:
    """(channelId, messageId, emoji) with the emoji encoded as a URL component."""
    return rows.select("channelId", "messageId", T.url_component(F.col("emoji")).alias("emoji"))


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch replaces its own folder, so a batch that is run again isn't doubled."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
