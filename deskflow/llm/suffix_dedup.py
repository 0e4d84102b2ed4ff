"""Removal of repeated passages of 400 bytes or more, exact over all documents, by suffix arrays of shards.

1. Anchors. Of all 32-byte strings in a 400-byte string the one with the least hash is its anchor. That choice sees
   only those bytes, so equal 400-byte strings have equal anchors at the same place. The strings of one anchor start
   next to each other; the bytes they cover are its region, and every string lies in exactly one region.
2. Regions whose anchor's hash occurs once can't hold a repeated string and go no further. Of the others each
   different one (by a 128-bit hash) is cut from a text once and goes to the shard of its anchor's hash.
3. In a shard regions fall into pieces by how many bytes a string has before the anchor. All strings of a piece contain
   its core, its middle bytes, so only pieces with equal cores share a string, and in the sort a core is two symbols, as
   are the bytes next to it that all its pieces agree in: of equal pieces little more than these is left. Each different
   piece enters the sort once, or twice if it occurs more than once. The shard's suffixes are sorted by
   induced sorting; strings whose permuted common prefixes span their length are repeated. Nothing else decides.
4. A group too large for a shard is dealt to more of them by longer cores: pieces of 32, then 8, then 2 places, where
   the bytes beside the core that a group can still differ in are so few that it fits. Equal pieces are combined
   before they meet. So no group is compared pair by pair and none is left out.
5. Every occurrence of a region gets the spans found in it; spans are joined for each document and removed.
"""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskflow.llm import common
from deskflow.llm.suffix_array import permuted_lcp, suffix_array

LENGTH, GRAM = 400, 32
HOT = 300  # different regions or pieces of a group beyond which it is dealt out by longer cores
WIDTHS = (32, 8, 2)  # places that the strings of one piece start at; groups of the last are bounded by two bytes
SHARD_SYMBOLS = 500_000  # symbols whose suffixes are sorted at a time, by whole groups
STEP = 6_000_000
U = np.uint64
_BYTES = common.mix(np.arange(1, 257, dtype=U) * U(0xC2B2AE3D27D4EB4F))
KIND = ["f", "h1", "h2", "left"]  # what tells one different region from another


def anchors(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, first, last) of the anchors inside the documents, ascending; the strings that start from
    ``first`` to ``last`` are the anchor's."""
    places, hashes, firsts, lasts, wide = [], [], [], [], length - gram + 1
    owner_ends = off[1:]
    for at in range(0, max(len(raw) - length + 1, 0), STEP):
        part = raw[at : at + STEP + length - 1]
        value, have = _BYTES[part], 1
        while have < gram:
            value = value[: len(value) - have] * common.powers(have + 1)[have] + value[have:]
            have *= 2
        value = common.mix(value)
        n, starts = len(value), len(part) - length + 1
        packed = (value >> U(23) << U(23)) | np.arange(n, dtype=U)
        padded = np.r_[packed, np.full(-n % wide, ~U(0), U)].reshape(-1, wide)
        fore = np.minimum.accumulate(padded, axis=1).ravel()
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:starts], fore[wide - 1 : wide - 1 + starts])
        start = np.arange(at, at + starts)
        whole = start + length <= owner_ends[np.minimum(np.searchsorted(owner_ends, start, "right"), len(owner_ends) - 1)]
        start, found = start[whole], (least[whole] & U((1 << 23) - 1)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, found[1:] != found[:-1]][: len(found)])
        places.append(found[new] + at)
        hashes.append(value[found[new]])
        firsts.append(start[new])
        lasts.append(start[np.r_[new[1:], len(found)][: len(new)] - 1])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, first, last = np.concatenate(places), np.concatenate(firsts), np.concatenate(lasts)
    new = np.r_[True, place[1:] != place[:-1]][: len(place)]  # an anchor's strings may lie on both sides of a step's end
    end = np.r_[new[1:], True][: len(place)]
    return place[new], np.concatenate(hashes)[new], first[new], last[end]


def _tasks(frame: DataFrame) -> int:
    """Tasks for steps whose work is large for their bytes, which adaptive execution would put into one."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def region_table(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tag, at, f, h1, h2, left, size): each region's first byte, its anchor's hash, its own 128-bit hash, bytes
    before the anchor and length."""
    import xxhash

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in common.slices(batch, "body"):
                raw, off = common.utf8(part.column("body"))
                place, f, low, last = anchors(raw, off, length)
                row = np.searchsorted(off, place, "right") - 1
                high = last + length
                view = memoryview(raw)
                hashed = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]), "<i8").reshape(-1, 2)
                ident, tag = (part.column(c).take(pa.array(row)) for c in ("doc_id", "tag"))
                yield pa.RecordBatch.from_arrays([ident, tag, pa.array(low - off[row]), pa.array(f.view(np.int64)), pa.array(hashed[:, 0].copy()), pa.array(hashed[:, 1].copy()), pa.array((place - low).astype(np.int32)), pa.array((high - low).astype(np.int32))], names=["doc_id", "tag", "at", *KIND, "size"])

    return docs.mapInArrow(run, "doc_id long, tag int, at long, f long, h1 long, h2 long, left int, size int")


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(f, h1, h2, left, n, hot, content) of ``wanted`` (doc_id, tag, at, f, h1, h2, left, size, n, hot)."""
    import xxhash

    lists = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "size", *KIND, "n", "hot")).alias("spots"))

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            for part in common.slices(batch, "body", 500_000):
                rows = []
                for body, spots in zip(part.column("body").to_pylist(), part.column("spots").to_pylist(), strict=True):
                    raw = (body or "").encode()
                    for s in spots:
                        content = raw[s["at"] : s["at"] + s["size"]]
                        if xxhash.xxh3_128_digest(content) == np.array([s["h1"], s["h2"]], "<i8").tobytes():
                            rows.append((s["f"], s["h1"], s["h2"], s["left"], s["n"], s["hot"], content))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*KIND, "n", "hot", "content"])

    joined = docs.join(lists, ["doc_id", "tag"]).select("body", "spots")
    return joined.mapInArrow(run, "f long, h1 long, h2 long, left int, n long, hot boolean, content binary")


def pieces(left: int, content: bytes, length: int, width: int = WIDTHS[0]) -> list[tuple[int, int, bytes, bytes, bytes]]:
    """(k, low, bytes before the core, core, bytes after it) of a region; ``low`` is the piece's first byte.

    Piece k holds the strings with k * width to (k + 1) * width - 1 bytes before the anchor, as far as the region has them.
    """
    out, least = [], left - (len(content) - length)
    for k in range(least // width, left // width + 1):
        low, core = left - min(left, (k + 1) * width - 1), left - k * width
        end, after = left - max(least, k * width) + length, core + length - width + 1
        out.append((k, low, content[low:core], content[core:after], content[after:end]))
    return out


def finer(before: bytes, after: bytes, width: int, to: int) -> list[tuple[int, int, bytes, bytes, bytes, bytes]]:
    """(k, low, before, joined to the core on the left, on the right, after) of a piece cut into pieces of ``to`` places."""
    out = []
    for k in range((width - 1 - len(after)) // to, len(before) // to + 1):
        most, right = min(len(before), (k + 1) * to - 1), width - (k + 1) * to
        low, core = len(before) - most, len(before) - k * to
        out.append((k, low, before[low:core], before[core:], after[:right], after[right : width - 1 - max(width - 1 - len(after), k * to)]))
    return out


Class = tuple[int, int, list[tuple[int, bytes, bytes]]]


def one_core(members: list[tuple[int, bytes, bytes]]) -> Class:
    """(left, right, members): how many bytes next to their core the pieces (how often, before, after) all agree in."""
    return len(commonprefix([m[1][::-1] for m in members])), len(commonprefix([m[2] for m in members])), members


def shard_spans(classes: list[Class], width: int) -> list[list[tuple[int, int] | None]]:
    """(first, last) start, in bytes from its first, of the repeated strings of each piece, or None.

    A class holds the different pieces of one core. The core, with the bytes next to it that all of them agree in, becomes
    two symbols above all bytes; a last symbol keeps texts apart. So a string with j bytes before the core becomes one of
    max(j - left, 0) + 2 + max(width - 1 - j - right, 0) symbols, equal to another exactly where it was, and it is repeated
    if it shares that many with the suffix sorted next to it on either side.
    """
    rows = [p for _, _, c in classes for p in c]
    if not rows:
        return []
    code = np.repeat(np.arange(len(classes)), [len(c) for _, _, c in classes])
    left, right = (np.array([c[i] for c in classes])[code] for i in (0, 1))
    texts = [m[1][: len(m[1]) - l] + b"\0\0" + m[2][r:] + b"\0" for l, r, c in classes for m in c]
    copies = np.minimum([p[0] for p in rows], 2)
    data = np.frombuffer(b"".join([t * n for t, n in zip(texts, copies.tolist(), strict=True)]), np.uint8).astype(np.uint16)
    row = np.repeat(np.arange(len(rows)), copies)
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size[row])
    before, after = (np.array([len(p[i]) for p in rows]) for i in (1, 2))
    core = end - size[row] + (before - left)[row]
    data[core], data[core + 1], data[end - 1] = 256 + (code[row] >> 8), 256 + (code[row] & 255), 512 + (len(classes) >> 8)
    sa = suffix_array(data)
    lcp = permuted_lcp(data, sa)
    near = np.zeros(len(data), np.int64)
    near[sa] = np.maximum(lcp[sa], np.r_[lcp[sa[1:]], 0])
    # The strings of each piece, by the bytes they have before the core; a piece's first copy speaks for both.
    least = width - 1 - after
    count = before - least + 1
    piece = np.repeat(np.arange(len(rows)), count)
    j = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + least[piece]
    ahead = np.maximum(j - left[piece], 0)
    place = core[np.cumsum(copies) - copies][piece] - ahead
    twice = near[place] >= ahead + 2 + np.maximum(width - 1 - j - right[piece], 0)
    low, high = np.full(len(rows), 1 << 30), np.full(len(rows), -1)
    np.minimum.at(low, piece[twice], (before[piece] - j)[twice])
    np.maximum.at(high, piece[twice], (before[piece] - j)[twice])
    found = iter([(a, b) if b >= 0 else None for a, b in zip(low.tolist(), high.tolist(), strict=True)])
    return [[next(found) for _ in c] for _, _, c in classes]


class _Shard:
    """Groups of regions that are sorted together; adding up their pieces and the spans found in them."""

    def __init__(self, length: int):
        self.length, self.symbols = length, 0
        self.regions: list[tuple] = []
        self.classes: list[Class] = []
        self.users: list[list[list[tuple[int, int]]]] = []

    def add(self, group: list[tuple]) -> None:
        """group: (f, h1, h2, left, n, content)."""
        cores: dict = {}
        for *key, n, content in group:
            for k, low, before, core, after in pieces(key[3], content, self.length):
                piece = cores.setdefault((k, core), {}).setdefault((before, after), [0, []])
                piece[0] += n
                piece[1].append((len(self.regions), low))
            self.regions.append(tuple(key))
        for found in cores.values():
            members = [(n, before, after) for (before, after), (n, _) in found.items()]
            if len(members) > 1 or members[0][0] > 1:  # a core that occurs once can't be in a repeated string
                left, right, _ = one = one_core(members)
                self.classes.append(one)
                self.users.append([used for _, used in found.values()])
                self.symbols += sum((len(b) - left + len(a) - right + 3) * min(n, 2) for n, b, a in members)

    def spans(self) -> pa.RecordBatch:
        low, high = [1 << 30] * len(self.regions), [-1] * len(self.regions)
        for used, found in zip(self.users, shard_spans(self.classes, WIDTHS[0]), strict=True):
            for places, span in zip(used, found, strict=True):
                if span:
                    for i, at in places:
                        low[i], high[i] = min(low[i], at + span[0]), max(high[i], at + span[1])
        rows = [(*r, a, b + self.length) for r, a, b in zip(self.regions, low, high, strict=True) if b >= 0]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*KIND, "low", "high"])


_SPANS = "f long, h1 long, h2 long, left int, low int, high int"


def _shards(regions: DataFrame, length: int) -> DataFrame:
    """(f, h1, h2, left, low, high): the bytes of regions that repeated strings cover; a group is whole in one shard."""

    def run(batches):
        shard, group, last = _Shard(length), [], None
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in (*KIND, "n", "content")], strict=True):
                if r[0] != last and group:
                    shard.add(group)
                    group = []
                    if shard.symbols >= SHARD_SYMBOLS or len(shard.regions) >= SHARD_SYMBOLS // 50:
                        yield shard.spans()
                        shard = _Shard(length)
                last = r[0]
                group.append(r)
        shard.add(group)
        yield shard.spans()

    return regions.select(*KIND, "n", "content").repartition(_tasks(regions), "f").sortWithinPartitions("f").mapInArrow(run, _SPANS)


_PIECE = "g1 long, g2 long, before binary, after binary, f long, h1 long, h2 long, left int, low int, n long"


def _pieces(rows: DataFrame, length: int, width: int, wider: int | None) -> DataFrame:
    """Rows of _PIECE: regions cut into pieces, or pieces of ``wider`` places cut on; a group (g1, g2) has one core."""
    import xxhash

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                base = (r["f"], r["h1"], r["h2"], r["left"])
                if wider is None:
                    for k, low, before, core, after in pieces(r["left"], r["content"], length, width):
                        g = np.frombuffer(xxhash.xxh3_128_digest(b"%d:%d:" % (r["f"], k) + core), "<i8").tolist()
                        out.append((*g, before, after, *base, low, r["n"]))
                else:
                    for k, low, before, left, right, after in finer(r["before"], r["after"], wider, width):
                        g = np.frombuffer(xxhash.xxh3_128_digest(b"%d:%d:%d:%d:" % (r["g1"], r["g2"], k, len(left)) + left + right), "<i8").tolist()
                        out.append((*g, before, after, *base, r["low"] + low, r["n"]))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["g1", "g2", "before", "after", *KIND, "low", "n"])

    return rows.repartition(_tasks(rows)).mapInArrow(run, _PIECE)


def _sorted_pieces(kinds: DataFrame, width: int) -> DataFrame:
    """(g1, g2, before, after, from, to): the first and last repeated string of each piece that has one."""

    def run(batches):
        keys, classes, symbols, last = [], [], 0, None

        def flush():
            rows = [(*key, *span) for group, found in zip(keys, shard_spans([one_core(c) for c in classes], width), strict=True) for key, span in zip(group, found, strict=True) if span]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=["g1", "g2", "before", "after", "from", "to"])

        for batch in batches:
            for g1, g2, before, after, n in zip(*[batch.column(c).to_pylist() for c in ("g1", "g2", "before", "after", "n")], strict=True):
                if (g1, g2) != last:
                    if symbols >= SHARD_SYMBOLS:
                        yield flush()
                        keys, classes, symbols = [], [], 0
                    last = (g1, g2)
                    keys.append([])
                    classes.append([])
                keys[-1].append((g1, g2, before, after))
                classes[-1].append((n, before, after))
                symbols += (len(before) + len(after) + 2) * min(n, 2)
        yield flush()

    dealt = kinds.repartition(_tasks(kinds), "g1", "g2").sortWithinPartitions("g1", "g2")
    return dealt.mapInArrow(run, "g1 long, g2 long, before binary, after binary, from int, to int")


def _large_groups(regions: DataFrame, length: int) -> list[DataFrame]:
    """Tables like that of ``_shards`` for regions whose groups are too large for a shard."""
    found, rows, wider, key = [], regions, None, ["g1", "g2", "before", "after"]
    for width in WIDTHS:
        cut = common.materialise(_pieces(rows, length, width, wider), "pieces")
        if not cut.limit(1).take(1):
            break
        kinds = common.materialise(cut.groupBy(key).agg(F.sum("n").alias("n")), "kinds")
        groups = kinds.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("different"), F.max("n").alias("most")).where("different > 1 or most > 1")
        groups = common.materialise(groups.select("g1", "g2", "different"), "groups")
        fits = groups.where(F.lit(width == WIDTHS[-1]) | (F.col("different") <= HOT)).select("g1", "g2")
        spans = common.materialise(_sorted_pieces(kinds.join(fits, ["g1", "g2"], "left_semi"), width), "sorted")
        back = cut.join(spans, key).groupBy(KIND).agg(F.min(F.col("low") + F.col("from")).alias("low"), F.max(F.col("low") + F.col("to") + length).alias("high"))
        found.append(common.materialise(back, "spans"))
        rows, wider = cut.join(groups.where(F.col("different") > HOT).select("g1", "g2"), ["g1", "g2"], "left_semi"), width
        common.discard(kinds)
        common.discard(spans)
    return found


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tag, low, high): byte spans, possibly overlapping, that cover what repeats; docs are (doc_id, tag, body)."""
    table = common.materialise(region_table(docs, length), "regions")
    half, ten = F.lit("9223372036854775808").cast("decimal(20,0)"), F.lit("1" + "0" * 14).cast("decimal(15,0)")
    spot = ((F.col("doc_id").cast("decimal(20,0)") + half) * ten + F.col("at").cast("decimal(14,0)")).cast("decimal(38,0)")
    kinds = table.withColumn("spot", spot).groupBy(KIND).agg(F.count(F.lit(1)).alias("n"), F.min("spot").alias("spot"), F.min_by("tag", "spot").alias("tag"), F.min("size").alias("size"))
    kinds = common.materialise(kinds, "kinds")
    groups = kinds.groupBy("f").agg(F.count(F.lit(1)).alias("different"), F.max("n").alias("most")).where("different > 1 or most > 1")
    wanted = kinds.join(groups.select("f", (F.col("different") > HOT).alias("hot")), "f").select(
        (F.floor(F.col("spot") / ten).cast("decimal(20,0)") - half).cast("long").alias("doc_id"), "tag", (F.col("spot") % ten).cast("long").alias("at"), "size", *KIND, "n", "hot"
    )
    cut = common.materialise(_cut(docs, wanted), "cut")
    common.discard(kinds)
    small = common.materialise(_shards(cut.where("not hot"), length), "spans")
    found = [small, *_large_groups(cut.where("hot"), length)]
    common.discard(cut)
    out = None
    for part in found:
        out = part if out is None else out.unionByName(part)
    return table.join(out, KIND).select("doc_id", "tag", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))


def _tag(ident: Column, body: Column) -> Column:
    return F.hash(ident.isNull(), body)


def remove_repeats(docs: DataFrame, length: int = LENGTH, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_bytes, n_removed, spans array<struct<low,high>>, kept binary) of every row; ids are integers.

    Every byte that lies in a string of ``length`` bytes which also starts anywhere else, in any document, is removed.
    A null text is empty; texts of fewer bytes lose nothing; texts of any length are read whole, in steps. Rows that
    repeat an id and a text repeat each other's strings, so all their bytes go; rows that repeat an id with different
    texts, and rows without an id, are documents of their own. An empty table gives no rows. Other columns, whatever
    their names, are not read.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(ident).cast("long").alias("real"), F.col(text).alias("body"))
    rows = rows.select("real", F.coalesce("real", F.xxhash64("body")).alias("doc_id"), _tag(F.col("real"), F.col("body")).alias("tag"), "body")
    spans = repeated_spans(rows.select("doc_id", "tag", "body"), length)
    lists = spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("low", "high")).alias("raw"))

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "body"):
                out = []
                for body, raw in zip(part.column("body").to_pylist(), part.column("raw").to_pylist(), strict=True):
                    data = (body or "").encode()
                    covered = np.zeros(len(data) + 1, np.int64)
                    if raw:
                        np.add.at(covered, [min(max(r["low"], 0), len(data)) for r in raw], 1)
                        np.add.at(covered, [min(r["high"], len(data)) for r in raw], -1)
                    inside = np.r_[False, np.cumsum(covered)[:-1] > 0, False]
                    edges = np.flatnonzero(inside[1:] != inside[:-1])
                    merged = [{"low": int(a), "high": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    kept = np.frombuffer(data, np.uint8)[~inside[1:-1]].tobytes() if merged else data
                    out.append((len(data), len(data) - len(kept), merged, kept))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("real"), *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], names=[ident, "n_bytes", "n_removed", "spans", "kept"])

    return rows.join(lists, ["doc_id", "tag"], "left").select("real", "body", "raw").mapInArrow(run, f"`{ident}` long, n_bytes long, n_removed long, spans array<struct<low: long, high: long>>, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(common.documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

SQL = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), p AS (
  SELECT doc_id, b, unnest(range(0, greatest(n - 399, 0))) AS s FROM d
), w AS (
  SELECT doc_id, s, md5(array_slice(b, s + 1, s + 400)) AS h FROM p
), t AS (
  SELECT doc_id, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), o AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS opens FROM t
), g AS (
  SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM o
), spans AS (
  SELECT doc_id, run, min(s) AS low, max(s) + 400 AS high FROM g GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY low) AS a, low AS z FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(high), 0), any_value(n) FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
), kept AS (
  SELECT doc_id, sha256(unhex(string_agg(hex(array_slice(b, a + 1, z)), '' ORDER BY a))) AS kept_sha256 FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(high - low) AS removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
