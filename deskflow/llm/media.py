"""Media columns as ISO base media containers (ISO/IEC 14496-12): write, walk and describe without decoding payloads.

``mux`` stores bytes as unsigned 8-bit mono samples in chunks; ``boxes`` walks nested boxes; ``describe`` decodes
the sample tables, or the runs of fragments, into codec, duration and keyframe byte ranges, which ``with_media`` stores
as columns next to the container; ``payload`` copies the samples those tables name.

A damaged container is read as far as its boxes are whole: a box that ends outside the one around it ends that walk, a
table cut short counts as far as it goes, and samples that lie outside the file are left out. Nothing raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from deskflow.llm import common

UNIT, RATE, GROUP = 64, 8000, 16  # bytes of a sample, samples of a second, samples from one keyframe to the next
DEEPEST = 16  # boxes inside each other; what lies deeper isn't looked at
MOST_SAMPLES = 1 << 28  # samples that a table without a row for each may name
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return b"".join([struct.pack(">I4s", size, kind) if size < 2**32 else struct.pack(">I4sQ", 1, kind, size + 8), *parts])


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def mux(data: bytes, codec: bytes = b"raw ") -> bytes:
    """A container whose one track holds ``data``, a multiple of 64 bytes, in samples of 64 bytes."""
    n = len(data) // UNIT
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    wide = len(data) + 16 >= 2**32
    at = len(head) + (16 if wide else 8)
    entry = box(codec, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, min(RATE, 65535) << 16))
    runs = -(-n // GROUP)
    chunk = at + np.arange(runs, dtype=np.int64) * GROUP * UNIT
    sizes = [(1, GROUP)] if n % GROUP == 0 else [(1, GROUP), (runs, n % GROUP)] if runs > 1 else [(1, n)]
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, UNIT)),
        full(b"stsc", struct.pack(">I", len(sizes)), *[struct.pack(">III", first, count, 1) for first, count in sizes]),
        full(b"stsz", struct.pack(">II", UNIT, n)),
        full(b"co64", struct.pack(">I", runs), chunk.astype(">i8").tobytes()) if wide else full(b"stco", struct.pack(">I", runs), chunk.astype(">u4").tobytes()),
        full(b"stss", struct.pack(">I", runs), (1 + np.arange(runs) * GROUP).astype(">u4").tobytes()),
    )
    span = n * UNIT
    minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, span, 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, span), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=3)
    mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, span, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
    body = struct.pack(">I4sQ", 1, b"mdat", len(data) + 16) if wide else struct.pack(">I4s", len(data) + 8, b"mdat")
    return b"".join([head, body, data, box(b"moov", mvhd, box(b"trak", tkhd, mdia))])


def boxes(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, begin, end of the content) of every box, outer before inner; a broken size ends the walk of its box."""
    left: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while left:
        at, end, path = left.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        begin = at + 8
        if size == 1 and at + 16 <= end:
            size, begin = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        stop = end if size == 0 else at + size
        if stop > end or stop < begin:
            continue
        yield (*path, kind), begin, stop
        left.append((stop, end, path))
        if kind in NESTED and len(path) < DEEPEST:
            left.append((begin, stop, (*path, kind)))


def _number(leaf: memoryview, at: int, width: int = 4) -> int:
    """A big-endian number, 0 where the box is too short."""
    return int.from_bytes(leaf[at : at + width], "big") if at + width <= len(leaf) else 0


def _table(leaf: memoryview, at: int, n: int, width: int = 1, kind: str = ">u4") -> np.ndarray:
    """Up to ``n`` rows of ``width`` numbers, as many as the box has whole."""
    size = np.dtype(kind).itemsize * width
    n = max(0, min(n, (len(leaf) - at) // size))
    out = np.frombuffer(leaf[at : at + n * size], kind).astype(np.int64)
    return out.reshape(-1, width) if width > 1 else out


def _sizes(kind: bytes, leaf: memoryview) -> np.ndarray:
    if kind == b"stsz":
        size, n = _number(leaf, 4), _number(leaf, 8)
        return np.full(min(n, MOST_SAMPLES), size, np.int64) if size else _table(leaf, 12, n)
    bits, n = _number(leaf, 7, 1), _number(leaf, 8)  # compact sizes of 4, 8 or 16 bits
    if bits == 4:
        raw = _table(leaf, 12, (n + 1) // 2, kind="u1")
        return np.stack([raw >> 4, raw & 15], 1).ravel()[:n]
    return _table(leaf, 12, n, kind="u1" if bits == 8 else ">u2")


def _run(leaf: memoryview, t: dict, base: int) -> None:
    """Add the samples of a fragment's run; what it doesn't give comes from the fragment's, then the track's defaults."""
    flags, n = _number(leaf, 1, 3), _number(leaf, 4)
    at, given = 8, {}
    if flags & 1:
        base, at = base + struct.unpack_from(">i", leaf, at)[0] if at + 4 <= len(leaf) else base, at + 4
    first = _number(leaf, at) if flags & 4 else None
    at += 4 if flags & 4 else 0
    names = [name for name, bit in (("duration", 0x100), ("size", 0x200), ("flags", 0x400), ("shift", 0x800)) if flags & bit]
    n = min(n, (len(leaf) - at) // (4 * len(names)) if names else MOST_SAMPLES)
    rows = _table(leaf, at, n, len(names)).reshape(n, len(names)) if names else np.zeros((n, 0), np.int64)
    for i, name in enumerate(names):
        given[name] = rows[:, i]
    each = {k: given.get(k, np.full(n, t["now"].get(k, 0), np.int64)) for k in ("duration", "size", "flags")}
    if first is not None and n:
        each["flags"] = np.r_[first, each["flags"][1:]]
    t["runs"].append((base + np.cumsum(each["size"]) - each["size"], each["size"], each["flags"] & 0x10000 == 0))
    t["ran"] = t.get("ran", 0) + int(each["duration"].sum())


def tracks(media: bytes) -> list[dict]:
    """For each track: codec, timescale, duration, seconds, and where its samples are (offsets, sizes, keyframes).

    An edit list gives the seconds that are presented; without one they are the track's own duration.
    """
    view, found, movie, now, at_moof = memoryview(media), [], 0, None, 0
    for path, a, b in boxes(view):
        kind, leaf = path[-1], view[a:b]
        if kind == b"mvhd":
            movie = _number(leaf, 20 if leaf[:1] == b"\1" else 12)
        elif kind == b"moof":
            at_moof = a - 8
        elif kind == b"trex":
            for t in found:
                if t.get("id") == _number(leaf, 4):
                    t["default"] = {"duration": _number(leaf, 12), "size": _number(leaf, 16), "flags": _number(leaf, 20)}
        elif kind == b"tfhd":
            flags, at = _number(leaf, 1, 3), 8
            now = next((t for t in found if t.get("id") == _number(leaf, 4)), None)
            if now is not None:
                now["base"], now["now"] = at_moof, dict(now.get("default", {}))
                for bit, name, width in ((1, "base", 8), (2, None, 4), (8, "duration", 4), (16, "size", 4), (32, "flags", 4)):
                    if flags & bit:
                        if name == "base":
                            now["base"] = _number(leaf, at, 8)
                        elif name:
                            now["now"][name] = _number(leaf, at, width)
                        at += width
        elif kind == b"trun" and now is not None:
            before = now["runs"][-1] if now["runs"] and not _number(leaf, 1, 3) & 1 and now.get("of") == at_moof else None
            _run(leaf, now, int(before[0][-1] + before[1][-1]) if before and len(before[0]) else now["base"])
            now["of"] = at_moof
        if kind == b"trak":
            found.append({"runs": []})
        if not found or b"trak" not in path:
            continue
        t = found[-1]
        if kind == b"tkhd":
            t["id"] = _number(leaf, 20 if leaf[:1] == b"\1" else 12)
        elif kind == b"mdhd":
            wide = leaf[:1] == b"\1"
            t["scale"], t["duration"] = _number(leaf, 20 if wide else 12), _number(leaf, 24 if wide else 16, 8 if wide else 4)
        elif kind == b"elst":
            wide = leaf[:1] == b"\1"
            step = 20 if wide else 12
            n = min(_number(leaf, 4), max(0, len(leaf) - 8) // step)
            t["edits"] = sum(_number(leaf, 8 + i * step, 8 if wide else 4) for i in range(n))
        elif kind == b"stsd":
            t["codec"] = bytes(leaf[12:16]).decode("latin-1") or "none"
        elif kind in (b"stsz", b"stz2"):
            t["sizes"] = _sizes(kind, leaf)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _table(leaf, 8, _number(leaf, 4), kind=">u8" if kind == b"co64" else ">u4")
        elif kind == b"stsc":
            t["stsc"] = _table(leaf, 8, _number(leaf, 4), 3)
        elif kind == b"stss":
            t["keys"] = _table(leaf, 8, _number(leaf, 4)) - 1
    for t in found:
        none = np.zeros(0, np.int64)
        sizes, chunks = t.get("sizes", none), t.get("chunks", none)
        each = np.zeros(len(chunks), np.int64)
        for first, count, _ in t.get("stsc", np.zeros((0, 3), np.int64)).tolist():  # an entry holds from its first chunk on
            each[max(first, 1) - 1 :] = min(count, len(sizes))
        ends = np.minimum(np.cumsum(each), len(sizes))
        each = np.diff(np.r_[0, ends])
        chunk = np.repeat(np.arange(len(chunks)), each)
        sizes = sizes[: len(chunk)]
        before = np.cumsum(sizes) - sizes
        offsets = chunks[chunk] + before - before[(ends - each)[chunk]] if len(chunk) else none
        is_key = np.zeros(len(sizes), bool)
        keys = t.get("keys", np.arange(len(sizes)))
        is_key[keys[(keys >= 0) & (keys < len(sizes))]] = True
        offsets, sizes, is_key = (np.concatenate([x, *[r[i] for r in t["runs"]]]) for i, x in enumerate((offsets, sizes, is_key)))
        inside = (offsets >= 0) & (offsets + sizes <= len(view))
        t["offsets"], t["sizes"], t["keys"] = offsets[inside], sizes[inside], np.flatnonzero(is_key[inside])
        own = (t.get("duration", 0) + t.get("ran", 0)) / max(1, t.get("scale", 1))
        t["seconds"] = t["edits"] / movie if t.get("edits") and movie else own
    return found


def payload(media: bytes) -> bytes:
    """The bytes of all samples, in order, as the tables give them."""
    view, out = memoryview(media), []
    for t in tracks(media):
        off, size = t["offsets"], t["sizes"]
        if len(off):
            breaks = np.flatnonzero(np.r_[True, off[1:] != off[:-1] + size[:-1]])
            for a, b in zip(off[breaks], np.r_[(off + size)[breaks[1:] - 1], off[-1] + size[-1]], strict=True):
                out.append(view[a:b])
    return b"".join(out)


def describe(media: bytes) -> tuple[str, float, list[tuple[int, int]]]:
    """Codec, duration in seconds and byte ranges from each keyframe to the next, of the first track; ``none`` without one."""
    found = tracks(media)
    if not found:
        return "none", 0.0, []
    t = found[0]
    ends, keys = t["offsets"] + t["sizes"], t["keys"]
    stops = np.r_[keys[1:], len(ends)] - 1 if len(keys) else keys
    return t.get("codec", "none"), t["seconds"], list(zip(t["offsets"][keys].tolist(), ends[stops].tolist(), strict=True))


def line(codec: str, seconds: float, ranges: list[tuple[int, int]]) -> str:
    """What ``describe`` gives, as text."""
    spans = np.array(ranges, np.int64).reshape(-1, 2)
    return f"codec={codec.strip()};seconds={seconds:.6f};keyframes={len(ranges)};first={ranges[0] if ranges else None};last={ranges[-1] if ranges else None};ranges={zlib.crc32(spans.astype('<i8').tobytes()):08x}"


def feature(media: bytes) -> str:
    return line(*describe(media))


RANGES = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def with_media(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_bytes, media, codec, seconds, keyframes): the container of each text and what its tables say.

    ``keyframes`` are byte ranges inside ``media``, from each keyframe to the next, so a reader can fetch one without the
    rest. A null text is empty and gets 64 zero bytes; texts of any length become one container. Rows that repeat an id,
    or have none, all come back. An empty table gives no rows; other columns are not read.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "body", 16_000_000):
                raw = [(t or "").encode() for t in part.column("body").to_pylist()]
                stored = [mux(pad(r)) for r in raw]
                said = [describe(m) for m in stored]
                columns = [pa.array([len(r) for r in raw], pa.int64()), pa.array(stored, pa.binary()), pa.array([d[0] for d in said]), pa.array([d[1] for d in said], pa.float64())]
                ranges = pa.array([[{"begin": a, "end": b} for a, b in d[2]] for d in said], RANGES)
                yield pa.RecordBatch.from_arrays([part.column("ident"), *columns, ranges], names=[ident, "n_bytes", "media", "codec", "seconds", "keyframes"])

    kind = dict(docs.dtypes)[ident]
    schema = f"`{ident}` {kind}, n_bytes long, media binary, codec string, seconds double, keyframes array<struct<begin: long, end: long>>"
    return docs.selectExpr(f"`{ident}` as ident", f"`{text}` as body").mapInArrow(run, schema)


def media_digests(media: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Read containers back and return digests of their payloads, and one line of the columns that describe them."""
    common.ship(media.sparkSession)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "media", 16_000_000):
                rows = []
                for stored, codec, seconds, keyframes in zip(*[part.column(c).to_pylist() for c in ("media", "codec", "seconds", "keyframes")], strict=True):
                    data = payload(stored)
                    said = line(codec, seconds, [(k["begin"], k["end"]) for k in keyframes])
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), said))
                columns = [pa.array([r[i] for r in rows], pa.string() if i in (1, 4, 5) else pa.int64()) for i in range(6)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=[ident, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = dict(media.dtypes)[ident]
    return media.select(ident, "n_bytes", "media", "codec", "seconds", "keyframes").mapInArrow(run, f"`{ident}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(with_media(common.documents(spark, sf_dir)))
