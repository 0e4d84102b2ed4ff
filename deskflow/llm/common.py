"""Helpers shared by the corpus operators: scratch tables, Arrow text access, vectorised word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from deskflow.session import ship

#: Bytes of text that one vectorised step handles at a time; the arrays it makes are about 50 times as large.
STEP_BYTES = 1_000_000
U64 = np.uint64
_LOCAL_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # sessions on one machine, such as the tests
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL_SCRATCH:
            _LOCAL_SCRATCH.append("file://" + tempfile.mkdtemp(prefix="deskflow-"))
        base = _LOCAL_SCRATCH[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage and survives lost executors.

    The shuffles of the write are deleted when it ends, not when the driver happens to collect garbage.
    """
    return materialise_parts([df], name, codec)


def materialise_parts(parts: Iterable[DataFrame], name: str, codec: str = "zstd") -> DataFrame:
    """``materialise`` one or more parts of a table in turn, so that only one part's shuffles are on disk at a time."""
    path = ""
    for df in parts:
        spark = df.sparkSession
        path = path or scratch(spark, name)
        with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.mode("append").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialise`` that no later step reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what is executed inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of few rows for what is executed inside: rows with two texts make large ones, held by JVM and Python at once."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``rows`` rows whose text has about ``most`` bytes; a longer text gets a run of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + most, "right"))))
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()  # workers are kept for later stages, with what their pools hold


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and the offset of each (one more than there are texts); null is empty."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(lower: bool, space: bytes = b" \t\n\x0b\x0c\r") -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z if ``lower``; white space has 0."""
    table = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    if lower:
        table[65:91] = table[97:123]
    table[list(space)] = 0
    return table


_LOWER, _EXACT = byte_table(True), byte_table(False)
_POWERS = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.r_[U64(1), np.full(max(n, 4096) - 1, 0xD6E8FEB86659FD93, U64)], dtype=U64)
    return _POWERS


def words(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of bytes that aren't white space: a 64-bit hash, the document's row and the first byte's place.

    Works through the bytes in steps that end at white space, so its arrays stay small for a text of any length.
    """
    table = _LOWER if lower else _EXACT
    hashes, starts, at, n = [], [], 0, len(raw)
    first = np.zeros(n + 1, bool)
    first[off] = True
    while at < n:
        end = min(n, at + 2 * STEP_BYTES)
        while end < n and table[raw[end]] and not first[end]:
            gap = np.flatnonzero((table[raw[end : end + 4096]] == 0) | first[end : end + min(4096, n - end)])
            end = min(n, end + (int(gap[0]) if len(gap) else 4096))
        value = table[raw[at:end]]
        inside = value != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[at + 1 : end]
        begin = np.flatnonzero(begins)
        if len(begin):
            span = np.diff(np.r_[begin, end - at])
            place = np.arange(begin[0], end - at) - np.repeat(begin, span)
            value = value[begin[0] :] * powers(int(span.max()) + 1)[place]
            hashes.append(mix(np.add.reduceat(value, begin - begin[0])))
            starts.append(begin + at)
        at = end
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(off, begin, "right") - 1, begin
