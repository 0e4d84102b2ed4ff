"""Health: status roll-ups, verdicts, reports, counters and content drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskflow.functions import text as T

STATUSES = ("ok", "fail", "skip", "warn")


def summary(checks: DataFrame, *by: str) -> DataFrame:
    """A count for each of the four statuses, zeros kept."""
    return checks.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES])


def verdict(counts: DataFrame) -> DataFrame:
    """Failing before warning before green; the exit code is 1 if anything fails."""
    total = F.col("n_ok") + F.col("n_fail") + F.col("n_skip") + F.col("n_warn")
    said = (
        F.when(F.col("n_fail") > 0, F.format_string("%d of %d checks FAILING. See above for fixes.", "n_fail", total))
        .when(F.col("n_warn") > 0, F.format_string("%d warning%s, but no hard failures.", "n_warn", F.when(F.col("n_warn") > 1, "s").otherwise("")))
        .otherwise("All green.")
    )
    return counts.withColumn("verdict", said).withColumn("exit_code", (F.col("n_fail") > 0).cast("int"))


def only_root_if_missing(checks: DataFrame, agent: str = "agent", pos: str = "pos") -> DataFrame:
    """Where an agent's first check (its root) failed, that row alone; else all rows."""
    roots = checks.groupBy(agent).agg(F.min_by("status", pos).alias("root"), F.min(pos).alias("first"))
    return checks.join(roots, agent).where((F.col("root") != "fail") | (F.col(pos) == F.col("first"))).drop("root", "first")


def report(checks: DataFrame, agent: str = "agent", pos: str = "pos") -> DataFrame:
    """(agent, report): a line for each check, names padded to the longest, with fixes below."""
    width = F.max(F.length("name"))
    rows = checks.groupBy(agent).agg(width.alias("w"), F.array_sort(F.collect_list(F.struct(pos, "name", "status", "detail", "fix"))).alias("rows"))
    line = lambda c: F.concat(F.lit("  "), T.pad_right(c["name"], F.col("w")), F.lit("  "), F.upper(c["status"]), F.coalesce(F.concat(F.lit(" — "), F.nullif(c["detail"], F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit("\n  "), F.repeat(F.lit(" "), F.col("w")), F.lit("        fix: "), F.nullif(c["fix"], F.lit(""))), F.lit("")))
    return rows.select(agent, F.array_join(F.transform("rows", line), "\n").alias("report"))


def counters(rows: DataFrame, failed: Column, *by: str) -> DataFrame:
    """(processed, failed) of attempted rows."""
    return rows.groupBy(*by).agg(F.count_if(~failed).alias("processed"), F.count_if(failed).alias("failed"))


def folder_counts(files: DataFrame, folder: str = "folder") -> DataFrame:
    """Files waiting and done, whatever their suffix."""
    return files.agg(F.count_if(F.col(folder) == "new").alias("n_new"), F.count_if(F.col(folder) == "cur").alias("n_cur"))


def drift(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """Hashes of two versions and whether they differ; a missing version hashes to the empty string."""
    return rows.withColumn("before_sha256", T.content_hash(before)).withColumn("after_sha256", T.content_hash(after)).withColumn("changed", F.col("before_sha256") != F.col("after_sha256"))
