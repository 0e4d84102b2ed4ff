"""Token ids as files of rANS blocks: static range asymmetric numeral systems with shared frequency tables.

1. Ids of every document (with an end id) are written to a scratch table, in as few bytes as the vocabulary needs.
2. Their counts over all documents, at most one row per id, become one table of frequencies that sum to 2**20.
3. Documents are dealt by ranges of their id and sorted. A task fills blocks of 32,768 ids; a document that doesn't fit
   goes on in the next ones, so a text of any length is many blocks of one length. Each block is coded by itself over 32 interleaved lanes (64-bit states, 32-bit words) with checkpoints of
   all lane states every 128 steps and a CRC of its ids. Blocks are rows of Parquet files, so Spark's commit protocol
   covers them and any store that Spark can write to will do.
4. Reading decodes blocks independently; all stretches between checkpoints of many blocks advance side by side. The
   CRCs of a document's parts, moved on by the bytes that follow, add up to its own in any order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskflow.llm import common
from deskflow.llm.tokenizing import ByteEncoder, byte_bpe_path

SCALE, LANES, EVERY, BLOCK_IDS, LOW = 20, 32, 128, 32_768, 1 << 31
GROUP_IDS = 1_000_000  # ids that are coded or decoded side by side
MAGIC = b"RNS1"
U = np.uint64


def frequencies(counts: dict[int, int], size: int) -> np.ndarray:
    """Counts scaled to sum to 2**SCALE, at least 1 for each id that occurs; what rounding leaves goes to the largest."""
    raw = np.zeros(size, np.float64)
    for i, n in counts.items():
        raw[i] = n
    if not raw.any():
        return raw.astype(np.int64)
    whole = np.maximum(np.floor(raw * (1 << SCALE) / raw.sum()).astype(np.int64), (raw > 0).astype(np.int64))
    order = np.argsort(-whole, kind="stable")
    over, at = int(whole.sum()) - (1 << SCALE), 0
    while over:
        i = order[at % len(order)]
        step = min(over, max(1, int(whole[i]) // 8), int(whole[i]) - 1) if over > 0 else over
        whole[i] -= step
        over, at = over - step, at + 1
    return whole


class Coder:
    """Codes and decodes lists of ids by one table of frequencies."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(U)
        self.start = (np.cumsum(freq) - freq).astype(U)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<i8").tobytes())

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """MAGIC, table CRC, ids, their CRC, words, checkpoints; then (word offset, lane states) of each; the words."""
        if not blocks:
            return []
        n = np.array([len(b) for b in blocks])
        steps = -(-n // LANES)
        top, even = int(steps.max()), int(n.min()) // LANES  # below ``even`` every lane has an id
        ids = np.zeros((len(blocks), top * LANES), np.uint32)
        for row, b in zip(ids, blocks, strict=True):
            row[: len(b)] = b
        ids = ids.reshape(len(blocks), top, LANES).transpose(1, 0, 2).astype(np.intp, order="C")
        state, lane = np.full((len(blocks), LANES), LOW, U), np.arange(LANES)
        words, full, saved = np.empty(ids.shape, "<u4"), np.empty(ids.shape, bool), {}
        for t in range(top - 1, -1, -1):
            f, on = self.freq.take(ids[t]), True
            if t >= even:
                on = t * LANES + lane < n[:, None]
                f[~on] = 1 << SCALE  # a lane without an id here keeps its state
            np.logical_and(on, state >= f << U(63 - SCALE), out=full[t])
            words[t] = state  # the low half; of these, those that are ``full`` are written
            state = np.where(full[t], state >> U(32), state)
            after = state // f * (U(1 << SCALE) - f) + state + self.start.take(ids[t])
            state = after if on is True else np.where(on, after, state)
            if t % EVERY == 0:
                saved[t // EVERY] = state
        emitted = full.sum(2)
        before = np.cumsum(emitted, axis=0) - emitted
        out = []
        for i, b in enumerate(blocks):
            own = words[:, i][full[:, i]]
            marks = -(-int(steps[i]) // EVERY)
            head = MAGIC + struct.pack("<IIIII", self.crc, len(b), zlib.crc32(b.astype("<u4").tobytes()), len(own), marks)
            points = b"".join(struct.pack("<I", int(before[k * EVERY, i])) + saved[k][i].astype("<u8").tobytes() for k in range(marks))
            out.append(head + points + own.tobytes())
        return out

    def decode(self, coded: list[bytes]) -> list[np.ndarray]:
        """The ids of each block; raises ValueError if a block is of another table or its CRC differs."""
        heads, states, at, span, streams, base = [], [], [], [], [], 0
        for data in coded:
            crc, n, ids_crc, words, marks = struct.unpack_from("<IIIII", data, 4)
            if data[:4] != MAGIC or crc != self.crc:
                raise ValueError("a block of another format or frequency table")
            points = np.frombuffer(data, np.dtype([("at", "<u4"), ("x", "<u8", LANES)]), marks, 24)
            heads.append((n, ids_crc, marks))
            states.append(points["x"])
            at.append(points["at"].astype(np.int64) + base)
            span.append(np.minimum(n - np.arange(marks) * EVERY * LANES, EVERY * LANES))
            streams.append(np.frombuffer(data, "<u4", words, 24 + marks * (4 + 8 * LANES)))
            base += words
        if not coded:
            return []
        stream = np.concatenate(streams)
        state, at, span = np.concatenate(states).astype(U), np.concatenate(at), np.concatenate(span)
        out = np.zeros((len(span), EVERY, LANES), np.uint32)
        lane, even = np.arange(LANES), int(span.min(initial=EVERY * LANES)) // LANES
        for t in range(min(EVERY, -(-int(span.max(initial=0)) // LANES))):
            slot = state & U((1 << SCALE) - 1)
            ids = self.slots.take(slot.view(np.int64))
            out[:, t] = ids
            after = self.freq.take(ids) * (state >> U(SCALE)) + slot - self.start.take(ids)
            low = after < U(LOW)
            if t >= even:
                on = t * LANES + lane < span[:, None]
                low &= on
                after = np.where(on, after, state)
            here, read = np.flatnonzero(low), np.count_nonzero(low, axis=1)
            place = np.repeat(at - (np.cumsum(read) - read), read) + np.arange(len(here))
            flat = after.reshape(-1)
            flat[here] = flat[here] << U(32) | stream[place]
            state, at = after, at + read
        result, row = [], 0
        for n, ids_crc, marks in heads:
            ids = out[row : row + marks].reshape(-1)[:n]
            row += marks
            if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
                raise ValueError("a block's CRC differs")
            result.append(ids)
        return result


def crc_after(crc: int, zeros: int) -> int:
    """The CRC-32 (reflected polynomial of zlib) of a message moved on by ``zeros`` bytes: ``crc(a + b)`` is
    ``crc_after(crc(a), len(b)) ^ crc(b)``. Multiplies by x**(8 * zeros), by repeated squaring."""

    def times(a: int, b: int) -> int:
        out = 0
        for bit in range(31, -1, -1):  # bit 31 stands for x**0
            if b >> bit & 1:
                out ^= a
            a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
        return out

    power = 0x00800000  # x**8
    while zeros:
        if zeros & 1:
            crc = times(crc, power)
        power, zeros = times(power, power), zeros >> 1
    return crc


def token_table(docs: DataFrame, path: str, end_id: int = 0, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row, with the end id after each document's ids; a null text has the end id alone."""

    def run(batches):
        coder = ByteEncoder.at(path)
        end = np.array([end_id], coder.dtype).tobytes()
        for batch in batches:
            for part in common.slices(batch, "body"):
                ids = [i + end for i in coder.encode([t or "" for t in part.column("body").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = dict(docs.dtypes)[ident]
    return docs.selectExpr(f"`{ident}` as doc_id", f"`{text}` as body").mapInArrow(run, f"doc_id {kind}, ids binary")


def id_counts(tokens: DataFrame, width: int, size: int) -> dict[int, int]:
    """How often each id occurs in all documents: at most ``size`` numbers come to the driver."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in common.slices(batch, "ids"):
                raw, _ = common.utf8(part.column("ids").cast(pa.large_binary()).view(pa.large_string()))
                total += np.bincount(raw.view(f"<u{width}") if len(raw) else np.zeros(0, int), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["id", "n"])

    return {r.id: r.n for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def write_blocks(tokens: DataFrame, freq: np.ndarray, width: int, path: str) -> None:
    """Write blocks of ids in ascending doc_id order (null last) to ``path``; shards ascend with the ids too."""
    packed = [freq]
    lists = ["doc_ids", "sizes", "totals", "offsets"]  # of each document's part: its ids, those of the document, those before the part

    def run(batches):
        coder = Coder(packed[0])
        shard, block, first, n = 0, 0, 0, 0
        parts, now, pending = [], [], []

        def close():
            nonlocal block, first, n
            pending.append((shard, block, first, n, *map(list, zip(*parts, strict=True)), np.concatenate(now)))
            block, first, n = block + 1, first + n, 0
            parts.clear(), now.clear()

        def flush():
            rows, coded = list(pending), coder.encode([p[-1] for p in pending])
            pending.clear()
            kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 4]
            return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], pa.array(coded, pa.binary())], names=["shard", "block", "first", "n_ids", *lists, "coded"])

        for batch in batches:
            for ident, shard, raw in zip(batch.column("doc_id").to_pylist(), batch.column("shard").to_pylist(), batch.column("ids"), strict=True):  # noqa: B007, B020
                own, at = np.frombuffer(raw.as_buffer(), f"<u{width}"), 0
                while at < len(own):
                    take = min(len(own) - at, BLOCK_IDS - n)
                    parts.append((ident, take, len(own), at))
                    now.append(own[at : at + take])
                    at, n = at + take, n + take
                    if n == BLOCK_IDS:
                        close()
                        if len(pending) * BLOCK_IDS >= GROUP_IDS:
                            yield flush()
        if parts:
            close()
        if pending:
            yield flush()

    order = [F.col("doc_id").asc_nulls_last(), F.crc32("ids")]  # small keys: a sample of them comes to the driver
    dealt = tokens.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("shard", F.spark_partition_id())
    schema = "shard int, block long, first long, n_ids long, doc_ids array<long>, sizes array<long>, totals array<long>, offsets array<long>, coded binary"
    dealt.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_blocks(spark: SparkSession, path: str, freq: np.ndarray) -> DataFrame:
    """Decode the files: (doc_id, start, n_tokens, ids_crc32), ``start`` being the ids of all documents before."""
    files = common.ship(spark).read.parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("in_shard"))  # a row per file, not per document
    shards = shards.select(F.col("shard").alias("of"), (F.sum("in_shard").over(Window.orderBy("shard")) - F.col("in_shard")).alias("base"))
    packed = [freq]

    def run(batches):
        coder = Coder(packed[0])
        for batch in batches:
            for part in common.slices(batch, "coded"):
                rows = []
                blocks = coder.decode(part.column("coded").to_pylist())
                for ids, first, shard, *lists in zip(blocks, *[part.column(c).to_pylist() for c in ("first", "shard", "doc_ids", "sizes", "totals", "offsets")], strict=True):
                    at = 0
                    for name, n, total, offset in zip(*lists, strict=True):
                        crc = zlib.crc32(ids[at : at + n].astype("<u4").tobytes())
                        rows.append((name, shard, first + at - offset, n, crc_after(crc, 4 * (total - offset - n)) if offset + n < total else crc))
                        at += n
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "shard", "inside", "n_tokens", "ids_crc32"])

    decoded = files.select("shard", "first", "doc_ids", "sizes", "totals", "offsets", "coded").mapInArrow(run, "doc_id long, shard int, inside long, n_tokens long, ids_crc32 long")
    whole = decoded.groupBy("doc_id", "shard", "inside").agg(F.sum("n_tokens").alias("n_tokens"), F.expr("bit_xor(ids_crc32)").alias("ids_crc32"))
    return whole.join(shards, whole["shard"] == shards["of"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end_id: int = 0, ident: str = "doc_id", text: str = "text") -> tuple[str, np.ndarray]:
    """Write the ids of ``docs`` as block files; returns their folder and the table of frequencies.

    Ids of documents are integers; a null id comes last. Rows that repeat an id all come, next to each other, in order of
    their ids' CRC. A null or empty text has the end id alone; texts of any length are cut over blocks. No rows give no
    blocks. Other columns, whatever their names, are not read.
    """
    spark = common.ship(docs.sparkSession)
    coder = ByteEncoder.at(path)
    tokens = common.materialise(token_table(docs, path, end_id, ident, text), "ids")
    freq = frequencies(id_counts(tokens, coder.dtype.itemsize, coder.size), coder.size)
    out = common.scratch(spark, "rans")
    write_blocks(tokens, freq, coder.dtype.itemsize, out)
    common.discard(tokens)
    return out, freq


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, freq = token_files(common.documents(spark, sf_dir), byte_bpe_path())
    return read_blocks(spark, folder, freq)
