"""N-gram Jaccard join with several global orders of the n-grams.

A pair of sets with Jaccard similarity t or more shares an n-gram among the first n - ceil(t n) + 1 of each under ANY
total order. Three orders are used: (1) from rare to frequent, (2) coarsely from rare to frequent with other ties,
(3) by a hash. Pairs come from an index of the first order's prefixes with a positional bound, must also share a
prefix n-gram under the second and third order, and only then are verified on their texts.

Links are found without pairing up groups of copies: equal sets are one representative; a first round verifies each
document against one pivot of each n-gram it is indexed by (the one where the n-gram comes first); a second round looks
for links that can still change a component, only at n-grams whose documents are in several components. A few documents
that share such an n-gram are paired. Of many, each is written as what it differs in from their pivot: two documents
link only if they also share enough of these differences, so the differences are filtered by prefixes again, under
orders of how rare they are among that pivot's documents. What the whole group shares then makes no candidates. So
``ngram_join`` knows components, not links; ``ngram_links`` verifies every candidate pair and counts each row's links.

Frequencies come from a table of 2**20 counters over all documents. A bound on its size costs nothing in exactness:
any order is valid, counters only make it a good one. Where every counter is full, rare and common n-grams mix, and more
documents share an indexed n-gram; such groups are what the differences are for.

Steps that shuffle every text or n-gram work on one part of many documents at a time, and on one pair of parts where
pairs get both texts, so the disk they take beside the tables is a share of the input that doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskflow.llm import common
from deskflow.llm.components import components

COUNTERS = 1 << 20
#: Rows of one n-gram that meet in a task of ``ngram_links``; an n-gram with more is cut into blocks, paired one by one.
BLOCK = 256
#: Open rows of one n-gram up to which the second round pairs them, so that a row meets a bounded number of others.
FEW = 64
#: Rows up to which all texts and n-grams are shuffled at once; more are dealt out to so many more parts, PARTS at most.
PART, PARTS = 400_000, 4
ORDERS = 5  # orders of a group's differences
U = np.uint64


def _order(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by owner, then key; owners ascend already."""
    by_key = np.argsort(key)
    kind = np.uint16 if len(owner) and owner[-1] < 65536 else np.int64
    return by_key[np.argsort(owner[by_key].astype(kind), kind="stable")]


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row) of the distinct n-grams of each text, in order of row and hash.

    Words are runs of bytes other than white space, with A-Z lower-cased. A text of fewer words is one n-gram; one
    without words has none.
    """
    hashes, owner, _ = common.words(*common.utf8(texts))
    count = np.bincount(owner, minlength=len(texts))
    values, rows = [], []
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        value = np.zeros(n, U)
        for k in range(words):
            value = value * U(0x9E3779B97F4A7C15) + hashes[k : k + n]
        whole = owner[:n] == owner[words - 1 :]
        values.append(common.mix(value[whole]))
        rows.append(owner[:n][whole])
    first = np.cumsum(count) - count
    for c in range(1, words):
        short = np.flatnonzero(count == c)
        if len(short):
            value = np.full(len(short), c, U)
            for k in range(c):
                value = value * U(0x9E3779B97F4A7C15) + hashes[first[short] + k]
            values.append(common.mix(value ^ U(0x5851F42D4C957F2D)))
            rows.append(short)
    if not values:
        return np.zeros(0, U), np.zeros(0, np.int64)
    value, row = np.concatenate(values), np.concatenate(rows)
    if len(values) > 1:
        at = np.argsort(row, kind="stable")
        value, row = value[at], row[at]
    at = _order(row, value)
    value, row = value[at], row[at]
    new = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])]
    return value[new], row[new]


def _sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    total = np.r_[U(0), np.cumsum(values, dtype=U)]
    ends = np.searchsorted(row, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]


def profile(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, tag, n, hi, lo) with a 128-bit key of each set, and one row of counters (in ``counts``) of each task."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in common.slices(batch, "body"):
                n = part.num_rows
                value, row = shingle_sets(part.column("body"), words)
                total += np.bincount((value >> U(44)).astype(np.int64), minlength=COUNTERS)
                hi, lo = _sums(value, row, n), _sums(common.mix(value ^ U(0xA5A5A5A5A5A5A5A5)), row, n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), pa.array(np.bincount(row, minlength=n), pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.nulls(n, pa.list_(pa.int64()))], names=["doc_id", "tag", "n", "hi", "lo", "counts"])
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 100_000):
            packed = (seen[at : at + 100_000] << 40) | np.minimum(total[seen[at : at + 100_000]], (1 << 40) - 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([packed], pa.list_(pa.int64()))], names=["doc_id", "tag", "n", "hi", "lo", "counts"])

    return docs.mapInArrow(run, "doc_id long, tag long, n long, hi long, lo long, counts array<long>")


def rarity(profiles: DataFrame) -> np.ndarray:
    """A level from 0 to 255 for each counter, about 8 times the logarithm to base 2; at most COUNTERS rows reach the driver."""
    cells = profiles.where("n = -1").select(F.explode("counts").alias("c")).select(F.shiftright("c", 40).cast("int").alias("cell"), F.col("c").bitwiseAND((1 << 40) - 1).alias("m"))
    scaled = F.least(F.lit(255), F.round(8 * F.log2(1 + F.sum("m"))))
    levels = common.materialise(cells.groupBy("cell").agg(scaled.cast("short").alias("level")), "levels")
    found = levels.toArrow()  # six bytes a row, not Python rows
    common.discard(levels)
    level = np.zeros(COUNTERS, np.uint8)
    level[found["cell"].to_numpy()] = found["level"].to_numpy().astype(np.uint8)
    return level


def _lists(texts: pa.Array, level: np.ndarray, words: int, share: tuple[int, int], orders: tuple[int, ...]) -> tuple[np.ndarray, list[pa.Array]]:
    """The size of each text's set, and a column of prefixes for each of the ``orders`` (0, 1 or 2)."""
    num, den = share
    value, row = shingle_sets(texts, words)
    n = np.bincount(row, minlength=len(texts))
    length = np.where(n > 0, n - -(-num * n // den) + 1, 0)
    first = np.cumsum(n) - n
    pick = np.repeat(first, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    ends = pa.array(np.r_[0, np.cumsum(length)].astype(np.int32))
    rank = level[(value >> U(44)).astype(np.int64)].astype(U)
    columns = []
    for k in orders:
        key = ((rank << U(56)) | (value & U((1 << 56) - 1))) if k == 0 else ((rank >> U(4)) << U(60)) | (common.mix(value ^ U(0x1234567)) >> U(4)) if k == 1 else common.mix(value ^ U(0x89ABCDEF))
        chosen = key[_order(row, key)][pick]
        flat = pa.array(chosen.view(np.int64)) if k == 0 else pa.array((common.mix(chosen) & U(0x7FFFFFFF)).astype(np.int32))
        columns.append(pa.ListArray.from_arrays(ends, flat))
    return n, columns


def prefixes(docs: DataFrame, level: np.ndarray, words: int, share: tuple[int, int]) -> DataFrame:
    """(doc_id, tag, n, one): the prefix of each set under the first order."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "body"):
                n, (one,) = _lists(part.column("body"), level, words, share, (0,))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), pa.array(n, pa.int64()), one], names=["doc_id", "tag", "n", "one"])

    return docs.mapInArrow(run, "doc_id long, tag long, n long, one array<long>")


def other_prefixes(docs: DataFrame, level: np.ndarray, words: int, share: tuple[int, int]) -> DataFrame:
    """(doc_id, body, two, three): texts with their prefixes under the second and third order."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "body"):
                _, columns = _lists(part.column("body"), level, words, share, (1, 2))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), *columns], names=["doc_id", "body", "two", "three"])

    return docs.mapInArrow(run, "doc_id long, body string, two array<int>, three array<int>")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough, from both texts; left and right have those of a and b."""
    num, den = share

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "left_body", 500_000):
                rows = part.num_rows
                both = pa.concat_arrays([part.column("left_body"), part.column("right_body")])
                value, row = shingle_sets(both, words)
                n = np.bincount(row, minlength=2 * rows)
                pair = np.where(row >= rows, row - rows, row)
                at = np.lexsort((value, pair))
                same = np.flatnonzero((value[at][1:] == value[at][:-1]) & (pair[at][1:] == pair[at][:-1]))
                shared = np.bincount(pair[at][same], minlength=rows)
                keep = den * shared >= num * (n[:rows] + n[rows:] - shared)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return _with_texts(pairs, left, right).mapInArrow(run, "a long, b long")


def _with_texts(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with both texts; a side that many pairs have is a skewed join, which Spark splits."""
    left, right = (texts.select(F.col("doc_id").alias(side), F.col("body").alias(f"{name}_body")) for texts, side, name in ((left, "a", "left"), (right, "b", "right")))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left_body", "right_body")


def differences(pairs: DataFrame, left: DataFrame, right: DataFrame, words: int) -> DataFrame:
    """(a, b, missing, differ): of each set a the n-grams that it and its pivot b don't share; ``missing`` are b's."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "left_body", 500_000):
                rows = part.num_rows
                value, row = shingle_sets(pa.concat_arrays([part.column("left_body"), part.column("right_body")]), words)
                pair = np.where(row >= rows, row - rows, row)
                at = np.lexsort((value, pair))
                value, pair, other = value[at], pair[at], row[at] >= rows
                same = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
                alone = ~(np.r_[False, same][: len(value)] | np.r_[same, False][: len(value)])
                ends = np.r_[0, np.cumsum(np.bincount(pair[alone], minlength=rows))].astype(np.int32)
                missing = np.bincount(pair[alone & other], minlength=rows)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(missing, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(value[alone].view(np.int64)))], names=["a", "b", "missing", "differ"])

    return _with_texts(pairs, left, right).mapInArrow(run, "a long, b long, missing long, differ array<long>")


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts))


@dataclass
class Index:
    """Where both joins start: the prefixes of one document for each different set, and their texts."""

    words: int
    share: tuple[int, int]
    sets: DataFrame  # (doc_id, n, hi, lo) of every row
    chosen: DataFrame  # (doc_id, n, hi, lo) of every id, whose text is the one with the least hash
    equal: DataFrame  # (hi, lo, n, rep) of every set with n-grams
    shared: DataFrame  # (token, doc_id, n, i, pivot, pivot_n, j) of n-grams that some other document has too
    texts: list[DataFrame]  # (doc_id, body, two, three) of the documents in shared, by _part of doc_id

    def enough(self, a: str, i: str, b: str, j: str) -> Column:
        """Whether sets of a and b n-grams can be similar enough if the first they share are at i and j."""
        num, den = self.share
        return (num + den) * F.least(F.col(a) - F.col(i), F.col(b) - F.col(j)) >= num * (F.col(a) + F.col(b))

    def cells(self, pairs: DataFrame) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
        """``pairs`` (a, b) of each two parts of the texts, with the two parts."""
        n = len(self.texts)
        for x, left in enumerate(self.texts):
            for y, right in enumerate(self.texts):
                yield pairs.where((_part("a", n) == x) & (_part("b", n) == y)) if n > 1 else pairs, left, right

    def links_of(self, pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (a, b), a table that is written already."""

        def meeting(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
            left, right = (texts.select(F.col("doc_id").alias(x), F.col("two").alias(f"two_{x}"), F.col("three").alias(f"three_{x}")) for texts, x in ((left, "a"), (right, "b")))
            return pairs.join(left, "a").join(right, "b").where(F.arrays_overlap("two_a", "two_b") & F.arrays_overlap("three_a", "three_b")).select("a", "b")

        kept = common.materialise_parts((meeting(*cell) for cell in self.cells(pairs.select("a", "b"))), "kept")
        with common.small_batches(pairs.sparkSession):
            links = common.materialise_parts((verified(*cell, self.words, self.share) for cell in self.cells(kept)), "links")
        common.discard(kept)
        return links


def indexed(docs: DataFrame, words: int, share: tuple[int, int], ident: str, text: str) -> Index:
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("body"), F.xxhash64(text).alias("tag"))
    profiles = common.materialise(profile(rows, words), "profiles")
    level = rarity(profiles)
    sets = common.materialise(profiles.where("n >= 0").drop("counts"), "sets")
    common.discard(profiles)
    first = sets.where("doc_id is not null").groupBy("doc_id").agg(F.min("tag").alias("tag"), *[F.min_by(c, "tag").alias(c) for c in ("n", "hi", "lo")])
    chosen = common.materialise(first, "chosen")
    equal = chosen.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"))
    reps = chosen.join(equal.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "tag")

    parts = min(PARTS, 1 + sets.count() // PART)
    named = rows.where("doc_id is not null")
    lists = prefixes(named, level, words, share).join(reps, ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"])
    lists = common.materialise(lists, "prefixes")
    index = lists.select("doc_id", "tag", "n", F.posexplode("one").alias("i", "token"))
    # A pivot is the document where the n-gram comes first, then the least id: one decimal, so that hash aggregation can keep it.
    shift, half = F.lit("1" + "0" * 20).cast("decimal(21,0)"), F.lit("9223372036854775808").cast("decimal(20,0)")
    place = (F.col("i").cast("decimal(12,0)") * shift + (F.col("doc_id").cast("decimal(20,0)") + half)).cast("decimal(38,0)")

    def pivots_of(index: DataFrame) -> DataFrame:
        pivots = index.withColumn("p", place).groupBy("token").agg(F.min("p").alias("p"), F.min_by("n", "p").alias("pivot_n"), F.count(F.lit(1)).alias("m")).where("m > 1")
        return pivots.select("token", "pivot_n", (F.col("p") % shift - half).cast("long").alias("pivot"), F.floor(F.col("p") / shift).cast("int").alias("j"))

    some = [index.where(_part("token", parts) == x) if parts > 1 else index for x in range(parts)]
    pivots = common.materialise_parts(map(pivots_of, some), "pivots")  # apart from the join, so that only one shuffle of the index is on disk at a time
    shared = common.materialise_parts((part.join(pivots, "token") for part in some), "shared")  # rows of n-grams that some other document has too
    common.discard(pivots)
    common.discard(lists)
    ids = common.materialise(shared.select("doc_id", "tag").distinct(), "ids")
    found = [[df.where(_part("doc_id", parts) == x) if parts > 1 else df for df in (named, ids)] for x in range(parts)]
    texts = [common.materialise(other_prefixes(df.join(wanted, ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"]), level, words, share), "texts") for df, wanted in found]
    common.discard(ids)
    return Index(words, share, sets, chosen, equal, shared.drop("tag"), texts)


def _open_pairs(index: Index, labelled: DataFrame) -> DataFrame:
    """(a, b): candidates whose link would join two components, written; labelled is ``shared`` with each document's ``label``.

    No link that matters is missed: a link between components shares an indexed n-gram, whose documents are all paired
    if they are FEW, and else all compared with their one pivot c. For these, sets a and b share
    |c| - missing(a) - missing(b) + (the differences they share) n-grams, so they need some number of differences in
    common. Where that is none, they link whatever they differ in; then each of them links to the document with the
    least need among those of like size, and those pairs are enough for their component. Else they share one among the
    first (differences - need + 1) of each under any order; ORDERS of them are used, all with rare ones first.
    """
    num, den = index.share
    whole, near = num + den, F.col("label")
    open_ = labelled.groupBy("token").agg(F.min(near).alias("low"), F.max(near).alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high").select("token", "m")
    rows = labelled.join(open_, "token")
    few = rows.where(F.col("m") <= FEW)
    left, right = (few.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "i", "n", "label")]) for side in "ab")
    close = left.join(right, "token").where((F.col("a_label") < F.col("b_label")) & index.enough("a_n", "a_i", "b_n", "b_i")).select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b"))

    many = rows.where((F.col("m") > FEW) & (F.col("doc_id") != F.col("pivot"))).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"), "n", "pivot_n", "label").distinct()
    pivoted = common.materialise(many, "pivoted")
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit((1 + 1e-9) * float(np.log(max(den / num, 1.001)))))
    need = num * F.col("n") + whole * F.col("missing")
    differing = (cell.join(differences(cell, left, right, index.words), ["a", "b"]) for cell, left, right in index.cells(pivoted))
    with common.small_batches(labelled.sparkSession):
        many = common.materialise_parts((df.select("a", "b", "label", "pivot_n", size.alias("size"), need.alias("need"), "differ") for df in differing), "differences")
    common.discard(pivoted)
    least = many.groupBy("b", "size").agg(F.min(F.struct("need", "a", "label")).alias("least")).select("b", F.col("size").alias("near"), "least")
    around = many.select("a", "b", "label", "need", "pivot_n", F.explode(F.array(*[F.col("size") + d for d in (-1, 0, 1)])).alias("near")).join(least, ["b", "near"])
    over = F.col("need") + F.col("least.need") - whole * F.col("pivot_n")
    sure = around.where((over <= 0) & (F.col("label") != F.col("least.label"))).select("a", F.col("least.a").alias("b"))
    wanted = around.groupBy("a", "b").agg(F.greatest(F.lit(1), F.ceil(F.min(over) / whole)).alias("wanted"))

    flat = many.select("a", "b", "label", "need", "pivot_n", F.size("differ").alias("size"), F.explode("differ").alias("gram"))
    rare = flat.groupBy("b", "gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    own = flat.join(rare, ["b", "gram"]).groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("label", "need", "pivot_n", "size")], F.collect_list(F.struct("k", "gram")).alias("grams"))
    own = own.join(wanted, ["a", "b"]).withColumn("alone", F.col("size") - F.size("grams"))  # differences of no other document come first
    own = own.withColumn("take", F.col("size") - F.col("wanted") + 1 - F.col("alone")).where("take > 0")

    def rarest(seed: int) -> Column:
        key = lambda g: F.struct(F.floor(F.log2(g["k"])), F.xxhash64(g["gram"], F.lit(seed)), g["gram"]) if seed else F.struct(g["k"], g["gram"])
        return F.slice(F.transform(F.array_sort(F.transform("grams", key)), lambda g: g["gram"]), F.lit(1), F.col("take").cast("int"))

    names = [f"order{i}" for i in range(ORDERS)]
    facts = ["a", "label", "need", "pivot_n", "size", "alone"]
    written = common.materialise(own.select("b", *facts, *[rarest(i).alias(n) for i, n in enumerate(names)]), "rarest")
    own = written.select("b", *facts, *names[1:], F.posexplode("order0").alias("i", "gram"))
    left, right = (own.select("b", "gram", *[F.col(c).alias(f"{side}_{c}") for c in (*facts, *names[1:], "i")]) for side in "ab")
    both = F.greatest(F.lit(1), F.ceil((F.col("a_need") + F.col("b_need") - whole * F.col("a_pivot_n")) / whole))  # what this pair needs
    reach = [F.col(f"{x}_size") - F.col(f"{x}_alone") - F.col(f"{x}_i") >= both for x in "ab"]
    top = lambda x, n: F.slice(f"{x}_{n}", F.lit(1), F.greatest(F.lit(0), F.col(f"{x}_size") - both + 1 - F.col(f"{x}_alone")).cast("int"))
    far = left.join(right, ["b", "gram"]).where((F.col("a_label") < F.col("b_label")) & reach[0] & reach[1])
    for n in names[1:]:
        far = far.where(F.arrays_overlap(top("a", n), top("b", n)))
    far = far.select(F.col("a_a").alias("a"), F.col("b_a").alias("b"))
    pairs = common.materialise(close.unionByName(sure).unionByName(far).distinct(), "pairs")
    for done in (many, written):
        common.discard(done)
    return pairs


def ngram_join(docs: DataFrame, words: int = 3, share: tuple[int, int] = (90, 100), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_shingles, component_id) of every row; ids are integers.

    Two documents link when their n-gram sets have Jaccard similarity share[0] / share[1] or more; component_id is
    the least id that links reach. A null or empty text has no n-grams and links with nothing, nor does a row without
    an id (its component_id is null). Rows that repeat an id are one document and all come back with its component; if
    their texts differ, the text with the least hash stands for it. Texts of any length are read whole, in steps. An
    empty table gives no rows. Other columns, whatever their names, are not read.
    """
    index = indexed(docs, words, share, ident, text)
    sets, shared = index.sets, index.shared
    star = shared.where((F.col("doc_id") != F.col("pivot")) & index.enough("n", "i", "pivot_n", "j")).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    star = common.materialise(star, "star")
    first = index.links_of(star)
    near = components(first)
    labelled = common.materialise(shared.join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "labelled")
    common.discard(shared)
    open_ = _open_pairs(index, labelled)
    common.discard(labelled)
    pairs = common.materialise(open_.join(star, ["a", "b"], "left_anti"), "pairs")
    for done in (open_, star):
        common.discard(done)
    second = index.links_of(pairs)
    for done in (pairs, *index.texts):
        common.discard(done)
    final = components(first.unionByName(second))

    known = index.equal.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", "n", F.coalesce("label", "rep").alias("component"))
    of_id = index.chosen.join(known, ["hi", "lo", "n"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    return sets.select("doc_id", "n").join(of_id, "doc_id", "left").select(F.col("doc_id").alias(ident), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), ident: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the least id, and all rows without an id."""
    heads = ngram_join(docs, words, share, ident).where(F.col(ident).eqNullSafe(F.col("component_id"))).select(F.col(ident).alias("head")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(heads, F.col(f"row.`{ident}`").cast("long").eqNullSafe(F.col("head")), "left_semi").select("row.*")


def ngram_links(docs: DataFrame, words: int = 3, share: tuple[int, int] = (90, 100), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_shingles, component_id, n_links) of every row: ``ngram_join`` and with how many other documents each links.

    Every pair of different sets that shares an indexed n-gram goes through the positional bound, the other two orders
    and the verification, whatever component it is in. Documents of a row's own set and of each linked set count by
    the sizes of these groups, without being paired up. Without an id n_links is null. Pairs grow with the square of
    a group of different near copies; nothing is capped.
    """
    index = indexed(docs, words, share, ident, text)
    sets, shared = index.sets, index.shared
    many = shared.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    placed = shared.join(many, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("every", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = placed.select("token", F.col("own").alias("x"), F.col("every").alias("y"), F.col("doc_id").alias("a"), F.col("i").alias("a_i"), F.col("n").alias("a_n"))
    right = placed.select("token", F.col("every").alias("x"), F.col("own").alias("y"), F.col("doc_id").alias("b"), F.col("i").alias("b_i"), F.col("n").alias("b_n"))
    pairs = left.join(right, ["token", "x", "y"]).where((F.col("a") < F.col("b")) & index.enough("a_n", "a_i", "b_n", "b_i")).select("a", "b").distinct()
    links = index.links_of(common.materialise(pairs, "pairs"))
    final = components(links)

    size = index.chosen.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    both = links.select(F.col("a").alias("node"), F.col("b").alias("rep")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("rep")))
    linked = both.join(size.select("rep", "size"), "rep").groupBy(F.col("node").alias("rep")).agg(F.sum("size").alias("others"))
    known = size.join(final.withColumnRenamed("node", "rep"), "rep", "left").join(linked, "rep", "left")
    known = known.select("hi", "lo", "n", F.coalesce("label", "rep").alias("component"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    of_id = index.chosen.join(known, ["hi", "lo", "n"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    out = sets.select("doc_id", "n").join(of_id, "doc_id", "left")
    return out.select(F.col("doc_id").alias(ident), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(common.documents(spark, sf_dir))


def op1_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links(common.documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.reached)::BIGINT AS component_id
FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

#: The same links, counted for each document as well.
LINKS_SQL = SQL.replace("AS component_id\n", "AS component_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id)::BIGINT AS n_links\n")
