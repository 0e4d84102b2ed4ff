"""Messages: normalising, gating, cleaning, last replies, newest items and rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskflow.functions import text as T

# Default and greatest number of messages of a fetch.
FETCH_DEFAULT, FETCH_MOST = 20, 50


def from_raw(raw: DataFrame, bot_id: str | None) -> DataFrame:
    """Raw API messages (id, channel_id, author, content, mentions) as flat messages."""
    mentioned = F.lit(False) if not bot_id else F.exists("mentions", lambda m: m["id"] == bot_id)
    return raw.select("id", F.col("channel_id").alias("channelId"), F.col("author.id").alias("authorId"), F.col("author.username").alias("authorName"), "content", F.coalesce(mentioned, F.lit(False)).alias("mentionsBot"))


def from_gateway(events: DataFrame, bot_id: str | None) -> DataFrame:
    """Gateway events (id, channelId, author, content, mentions with a map of users by id) as flat messages, our own left out."""
    mentioned = F.map_contains_key("mentions.users", F.lit(bot_id)) if bot_id else F.lit(False)
    others = events.where(not_own(F.col("author.id"), bot_id))
    return others.select("id", "channelId", F.col("author.id").alias("authorId"), F.col("author.username").alias("authorName"), "content", F.coalesce(mentioned, F.lit(False)).alias("mentionsBot"))


def allowed(messages: DataFrame, channels: DataFrame, column: str = "channelId") -> DataFrame:
    """Rows of listed channels; the list is small, and Spark broadcasts it when its size allows."""
    return messages.join(channels.select(F.col(channels.columns[0]).alias(column)).distinct(), column, "left_semi")


def split_outbound(replies: DataFrame, channels: DataFrame, column: str = "channelId") -> tuple[DataFrame, DataFrame]:
    """(sent, rejected): replies to a channel that isn't listed are rejected, not dropped."""
    listed = channels.select(F.col(channels.columns[0]).alias(column)).distinct()
    return replies.join(listed, column, "left_semi"), replies.join(listed, column, "left_anti").withColumn("error", F.concat(F.lit("channel not allowed: "), F.col(column)))


def require_allowed(column: Column, channels: Sequence[str]) -> Column:
    """The channel, or an error at run time."""
    return F.when(column.isin(*channels), column).otherwise(F.raise_error(F.concat(F.lit("channel not allowed: "), F.coalesce(column, F.lit("null")))).cast("string"))


def not_own(author: Column, own: str | None) -> Column:
    """True for other authors, bots included; an unset or empty own id lets all pass."""
    return author != own if own else F.lit(True)


def prompts(messages: DataFrame, channels: DataFrame, dispatch_all: bool = False, own: str | None = None) -> DataFrame:
    """Messages that become prompts, with ``prompt``: listed channel, not our own, a mention or all, text left."""
    gate = F.lit(True) if dispatch_all else F.col("mentionsBot")
    kept = allowed(messages.where(gate & not_own(F.col("authorId"), own)), channels)
    return kept.withColumn("prompt", T.clean_mentions(F.col("content"))).where(F.length("prompt") > 0)


def last_assistant(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, raw): text of the last assistant turn, of equal turns the greatest; earlier turns don't stand in for an empty one."""
    return turns.where("role = 'assistant'").groupBy(key).agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("raw")))["raw"].alias("raw"))


def final_replies(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, reply): the last assistant text, trimmed and bounded; empty ones are dropped."""
    trimmed = last_assistant(turns, key).select(key, T.js_trim(F.col("raw")).alias("reply"))
    return trimmed.where(F.length("reply") > 0).select(key, T.bounded(F.col("reply")).alias("reply"))


def captured_text(deltas: DataFrame, turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, captured): deltas (key, seq, delta) on end in order, or the last assistant text if there are none."""
    joined = deltas.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda d: d["delta"]), "").alias("streamed"))
    return last_assistant(turns, key).join(joined, key, "full").select(key, F.coalesce(F.nullif("streamed", F.lit("")), "raw").alias("captured"))


def limit_of(limit: int | None, default: int, most: int) -> int:
    return min(default if limit is None else limit, most)


def newest(messages: DataFrame, channel: str, ts: str, ident: str, limit: int | None = None) -> DataFrame:
    """The newest rows of each channel, with ``rn`` from 1; the bound is pushed below the window's shuffle."""
    order = Window.partitionBy(channel).orderBy(F.col(ts).desc(), F.col(ident).desc())
    return messages.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit_of(limit, FETCH_DEFAULT, FETCH_MOST))


def rendered(rows: DataFrame, channel: str, ident: str, author: str, content: str) -> DataFrame:
    """(channel, rendered): ``[id] author: content`` lines in order of ``rn``."""
    line = F.concat(F.lit("["), F.col(ident).cast("string"), F.lit("] "), F.col(author).cast("string"), F.lit(": "), F.col(content))
    lines = rows.groupBy(channel).agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))).alias("lines"))
    return lines.select(channel, F.array_join(F.transform("lines", lambda l: l["line"]), "\n").alias("rendered"))


def with_default(rows: DataFrame, wanted: DataFrame, key: str, column: str, text: str) -> DataFrame:
    """A row for every wanted key, with ``text`` where there is none."""
    return wanted.join(rows, key, "left").withColumn(column, F.coalesce(column, F.lit(text)))


def throttled(responses: DataFrame) -> DataFrame:
    """Responses of status 429 with what the retry-after header says."""
    return responses.where("status = 429").withColumn("retry_after", F.coalesce(F.element_at("headers", "retry-after"), F.lit("?")))
