"""Capability resolution against a catalog, configuration checks and dependency lockstep."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskflow.functions import text as T

NAME = r"\A[a-z0-9-]+\z"
# What each kind of configuration requires, as (rule for a value, whether it must be there).
DIGITS, FILLED, FLAG = r"\A[0-9]+\z", r"(?s)\A.+\z", r"\A(?:true|false)\z"


def valid_name(s: Column) -> Column:
    return s.rlike(NAME)


def config_error(config: Column, rules: Mapping[str, tuple[str, bool]]) -> Column:
    """The first error of a map of strings under ``rules``, or null: unknown keys, then missing, then bad values."""
    extra = F.array_sort(F.array_except(F.map_keys(config), F.array(*[F.lit(k) for k in rules])))
    error = F.when(F.size(extra) > 0, F.concat(F.lit("unexpected property /"), extra[0]))
    for key, (rule, required) in rules.items():
        value = F.element_at(config, key)
        if required:
            error = error.when(value.isNull(), F.lit(f"missing property /{key}"))
        error = error.when(value.isNotNull() & ~value.rlike(rule), F.lit(f"invalid value at /{key}"))
    return error


def duplicates(rows: DataFrame, group: str, name: str, pos: str) -> DataFrame:
    """Rows that repeat an earlier name of their group."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group, name).orderBy(pos))).where("nth > 1").drop("nth")


def resolve(agents: DataFrame, catalog: DataFrame) -> DataFrame:
    """(agent, packages, error): names in order against the catalog (name, package, not_yet).

    Only the first offender is reported: declared twice, unknown, not there yet, or a bad configuration
    (``config_errors``, a map from name to error, if the agents have it). With an error there are no packages.
    """
    own = agents.columns
    exploded = agents.select("agent", *(["config_errors"] if "config_errors" in own else []), F.posexplode_outer("names").alias("pos", "name"))
    first = F.row_number().over(Window.partitionBy("agent", "name").orderBy("pos")) == 1
    rows = exploded.withColumn("first", first).join(catalog, "name", "left")
    bad = F.element_at("config_errors", F.col("name")) if "config_errors" in own else F.lit(None).cast("string")
    quoted = F.concat(F.lit('capability "'), F.col("name"), F.lit('" '))
    error = F.when(F.col("name").isNull(), F.lit(None)).when(~F.col("first"), F.concat(quoted, F.lit("is declared twice"))).when(F.col("package").isNull(), F.concat(quoted, F.lit("is unknown"))).when(F.col("not_yet"), F.concat(quoted, F.lit("is not there yet"))).when(bad.isNotNull(), F.concat(quoted, F.lit("config is invalid: "), bad))
    rows = rows.withColumn("error", error)
    found = rows.groupBy("agent").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error"), F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("pos", "package")))).alias("found"))
    return found.select("agent", F.when(F.col("error").isNull(), F.array_join(F.transform("found", lambda c: c["package"]), ",")).alias("packages"), "error")


def config_env(resolved: DataFrame, prefix: str) -> DataFrame:
    """(agent, env): variable name to JSON of each capability's configuration; of clashing names the last wins."""
    entries = resolved.select("agent", "pos", T.env_var_name(F.col("name"), prefix).alias("key"), F.coalesce(F.to_json("config"), F.lit("{}")).alias("value"))
    last = entries.groupBy("agent", "key").agg(F.max_by("value", "pos").alias("value"))
    return last.groupBy("agent").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("env"))


def lockstep(manifests: DataFrame) -> DataFrame:
    """(package, dep, declared, shipped) of internal dependencies whose range doesn't hold the shipped version.

    manifests: (name, version, dependencies, devDependencies, peerDependencies); of a name in several sections the
    last section counts; workspace markers are accepted.
    """
    sections = ("dependencies", "devDependencies", "peerDependencies")
    each = None
    for i, s in enumerate(sections):
        part = manifests.select(F.col("name").alias("package"), F.lit(i).alias("section"), F.explode(s).alias("dep", "declared"))
        each = part if each is None else each.unionByName(part)
    merged = each.groupBy("package", "dep").agg(F.max_by("declared", "section").alias("declared"))
    shipped = manifests.where("name <> '' and version <> ''").select(F.col("name").alias("dep"), F.col("version").alias("shipped"))
    return merged.join(shipped, "dep").where(~F.col("declared").isin("workspace:*", "workspace:^") & ~F.contains("declared", "shipped")).select("package", "dep", "declared", "shipped")


def roles(texts: DataFrame, settings: DataFrame) -> DataFrame:
    """Roles that have both a text and settings (role, text) / (role, ...)."""
    return texts.join(settings, "role")


def personas(agents: DataFrame, texts: DataFrame) -> DataFrame:
    """Every agent with its persona, empty where there is none."""
    return agents.join(texts, "agent", "left").withColumn("text", F.coalesce("text", F.lit("")))
