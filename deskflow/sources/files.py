"""File sources: message inboxes, configuration text, roles, personas and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a message file.
MAIL = "id string, `from` string, `to` string, body string, timestamp string, read boolean, headers map<string,string>"
MANIFEST = "name string, version string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"


def parse_mail(raw: DataFrame, content: str = "content") -> DataFrame:
    """(file, mail, poison, content): each file's text as a message. Bad JSON, ``null`` and an empty file are poison.

    Files are parsed from their whole text. Spark's own file sources never list a file of no bytes, so ``inbox``
    has no row for one; texts from other sources that are empty are poison.
    """
    text = F.col(content).cast("string")
    mail = F.from_json(text, MAIL, {"mode": "PERMISSIVE"})
    fine = F.expr(f"try_parse_json(cast({content} as string))").isNotNull() & F.trim(text).startswith("{") & mail.isNotNull()
    return raw.select(F.col("path").alias("file"), mail.alias("mail"), (~F.coalesce(fine, F.lit(False))).alias("poison"), text.alias("content"))


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """A batch read of all ``*.json`` files of a folder, one message each."""
    return parse_mail(spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder))


def inbox_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of a folder's ``*.json`` files; files already there are read too, each once for a checkpoint."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return parse_mail(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).load(folder))


def unseen(files: DataFrame, seen: DataFrame, name: str = "file") -> DataFrame:
    """Files with the suffix ``.json`` that were not seen before."""
    return files.where(F.col(name).endswith(".json")).join(seen.select(name), name, "left_anti")


def config_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; a path that doesn't exist is an error."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def folder_of(path: Column) -> Column:
    """The last folder of a file's path."""
    return F.element_at(F.split(path, "/"), -2)


def role_files(spark: SparkSession, root: str, text: str = "soul.md", settings: str = "role.json", schema: str = "name string, description string") -> DataFrame:
    """Roles under ``root/*/`` that have both their text and their settings."""
    texts = config_text(spark, f"{root}/*/{text}").select(folder_of(F.col("path")).alias("role"), "text")
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{settings}").withColumn("role", folder_of(F.col("_metadata.file_path")))
    return texts.join(rows, "role")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All ``package.json`` files below ``root/*/``."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(f"{root}/*/package.json")


def env_config(rows: DataFrame, value: str, schema: str) -> DataFrame:
    """Configuration from JSON in a column, as a struct ``config``; what doesn't parse is null."""
    return rows.withColumn("config", F.from_json(value, schema))


def probe(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, there, mode, n_files) of wanted paths: whether there is one, its permission bits, how many files it holds.

    The driver asks the path's own file system; meant for the few paths of a health check, not for listings.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        system = path.getFileSystem(conf)
        if not system.exists(path):
            rows.append((p, False, None, None))
            continue
        status = system.getFileStatus(path)
        n = sum(f.isFile() for f in system.listStatus(path)) if status.isDirectory() else None
        rows.append((p, True, int(status.getPermission().toShort()), n))
    return spark.createDataFrame(rows, "path string, there boolean, mode int, n_files int")


def file_facts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of a folder's files, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
