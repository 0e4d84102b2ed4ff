"""The mail consumer as a structured stream: good messages go to a handler, what fails to dead letters.

The handler runs once for a batch: its result is written first, and every other table is derived from what was written.
Each file is handled once for a checkpoint; micro-batches never overlap; files that were there before the start are
handled too. Spark lets one query at a time own a checkpoint, which is the lock. A message that fails isn't tried again
by this consumer; ``retry`` tries dead letters again, as does a consumer with a new checkpoint.

Below ``out``: ``handled`` (what the handler said), ``status`` (file, ok, poison), ``cur`` (file, mail) of messages that
are done, and ``dead`` (file, content, reason, attempt) of those that failed. A batch that is run again after a failure
replaces its own folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deskflow.sources import files

Handler = Callable[[DataFrame], DataFrame]


def _handle(rows: DataFrame, handler: Handler | None, out: str, batch: str, attempt: int) -> None:
    spark = rows.sparkSession
    tried = rows.where("not poison").select("file", "mail")
    said = handler(tried) if handler else tried.withColumn("ok", F.lit(True))
    said.select("file", F.coalesce("ok", F.lit(False)).alias("ok")).write.mode("overwrite").parquet(f"{out}/handled/{batch}")
    done = spark.read.schema("file string, ok boolean").parquet(f"{out}/handled/{batch}").groupBy("file").agg(F.min("ok").alias("ok"))
    judged = rows.join(done, "file", "left").withColumn("ok", F.coalesce("ok", F.lit(False)) & ~F.col("poison"))
    judged.where("ok").select("file", "mail").write.mode("overwrite").parquet(f"{out}/cur/{batch}")
    reason = F.when(F.col("poison"), "not a message").otherwise("handler failed")
    judged.where("not ok").select("file", "content", reason.alias("reason"), F.lit(attempt).alias("attempt")).write.mode("overwrite").parquet(f"{out}/dead/{batch}")
    judged.select("file", "ok", "poison").write.mode("overwrite").parquet(f"{out}/status/{batch}")  # last: a batch without it didn't end


def consume(spark: SparkSession, folder: str, out: str, checkpoint: str, handler: Handler | None = None, every: str | None = None, files_per_batch: int = 1) -> StreamingQuery:
    """Start the consumer. ``every`` polls at an interval (such as ``2 seconds``); without it, what is there is read once.

    ``handler`` maps a batch of (file, mail) to rows with ``file`` and a boolean ``ok``; messages that aren't ok, or that it
    gives no row for, are dead letters.
    """
    stream = files.inbox_stream(spark, folder, files_per_batch)
    writer = stream.writeStream.foreachBatch(lambda rows, number: _handle(rows, handler, out, f"batch={number}", 1)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def dead_letters(spark: SparkSession, out: str) -> DataFrame:
    """(file, content, reason, attempt): the last failure of each message that isn't done by now."""
    failed = spark.read.parquet(f"{out}/dead").groupBy("file").agg(F.max(F.struct("attempt", "reason", "content")).alias("last"))
    done = spark.read.parquet(f"{out}/cur").select("file")
    return failed.join(done, "file", "left_anti").select("file", "last.content", "last.reason", "last.attempt")


def retry(spark: SparkSession, out: str, handler: Handler, most: int = 3) -> int:
    """Hand messages that a handler failed on to it again, up to ``most`` attempts each; returns the attempt's number.

    Texts that are no messages stay dead. Attempt n of all messages goes to a folder of its own, so a retry that is
    repeated after a crash replaces what it had written.
    """
    left = dead_letters(spark, out).where((F.col("reason") == "handler failed") & (F.col("attempt") < most))
    last = left.agg(F.max("attempt")).first()[0]
    if last is None:
        return 0
    rows = files.parse_mail(left.where(F.col("attempt") == last).select(F.col("file").alias("path"), "content"))
    _handle(rows, handler, out, f"batch=retry{last + 1}", last + 1)
    return last + 1


def stop(query: StreamingQuery) -> None:
    """Let the batch in hand end, then stop; stopping again does nothing."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()


def stats(spark: SparkSession, out: str) -> DataFrame:
    """(processed, failed) so far, first attempts and later ones."""
    return spark.read.parquet(f"{out}/status").agg(F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("failed"))
