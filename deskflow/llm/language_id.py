"""Language identification by bit-sliced Bloom filters over letter n-grams.

One table of cells serves all languages: bit l of a cell belongs to the filter of language l, so the AND of the few
cells that an n-gram hashes to is the mask of all languages that contain it. A document's masks are counted per
language, each count is corrected for that filter's rate of false positives, and the largest share decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskflow.llm import common

GRAM, PROBES = 4, 3
DOCS_PER_LANGUAGE = 4000  # expected size of the bounded sample that the filters are fitted on
LEAST_RATE = 3e-6  # a language contains an n-gram that it has at this rate or more, at most 333,333 n-grams; n-grams met once don't count
MOST_CELLS = 1 << 22
LEAST_GRAMS = 3
UNKNOWN = "und"
_TABLES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    if not _TABLES:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _TABLES.append(table)
    return _TABLES[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n-grams that start or end in a letter, the text of each, and which texts have a letter.

    A run of other characters counts as one edge, which n-grams may hold; texts have an edge at both ends.
    """
    n = np.array([len(t) + 1 for t in texts])
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _letters()[points]
    owner = np.repeat(np.arange(len(texts)), n)
    has = np.bincount(owner[code > 0], minlength=len(texts)) > 0
    keep = np.flatnonzero(np.r_[True, (code[1:] > 0) | (code[:-1] > 0) | (owner[1:] != owner[:-1])])
    code, owner = code[keep].astype(np.uint64), owner[keep]
    if len(code) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    value, whole = code[: len(code) - GRAM + 1].copy(), owner[: len(code) - GRAM + 1] == owner[GRAM - 1 :]
    for k in range(1, GRAM):
        value = value * np.uint64(0x110000 * 2 + 1) + code[k : len(code) - GRAM + 1 + k]
    ends = (code[: len(value)] > 0) | (code[GRAM - 1 :] > 0)
    pick = whole & ends
    return common.mix(value[pick]), owner[: len(value)][pick], has


@dataclass
class Filters:
    languages: list[str]
    cells: np.ndarray  # masks: cells x words of 64 languages
    false: np.ndarray  # rate of false positives of each language
    common: int  # the language of the most documents

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """The languages whose filters hold each n-gram, as bits."""
        found = None
        for place in places(hashes, len(self.cells)):
            found = self.cells[place] if found is None else found & self.cells[place]
        return found

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        return self.weigh(texts)[:2]

    def weigh(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language and score of each text, and how many n-grams it has."""
        hashes, owner, has = grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        right = np.zeros((len(texts), len(self.languages)))
        if len(hashes) and self.languages:
            masks = self.masks(hashes)
            for k in range(len(self.languages)):
                bit = masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)
                hits = np.bincount(owner, weights=bit.astype(np.float64), minlength=len(texts))
                right[:, k] = np.maximum(hits - n * self.false[k], 0) / (1 - self.false[k])
        total = right.sum(1)
        best = right.argmax(1) if self.languages else np.zeros(len(texts), int)
        best = np.where(total > 0, best, self.common)
        score = np.where(total > 0, right.max(1, initial=0) / np.maximum(total, 1e-9), 0.0)
        known = has & bool(self.languages)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0), n


def places(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cells that each n-gram hashes to; ``cells`` is a power of two."""
    bits = np.uint64(cells - 1)
    return [((hashes >> np.uint64(20 * k)) * np.uint64(2 * k + 1) & bits).astype(np.int64) for k in range(PROBES)]


def build(grams: DataFrame, docs: dict[str, int]) -> Filters:
    """Filters of (lang, gram): tasks set bits, equal cells are combined by OR, and the cells that are set come as columns.

    There are about 8 cells for an n-gram, at most MOST_CELLS; beyond that filters are fuller, which the correction for
    false positives takes into account. So what reaches the driver is bounded whatever the number of n-grams.
    """
    names = sorted(docs)
    at, wide = {l: i for i, l in enumerate(names)}, max(1, -(-len(names) // 64))
    cells = 1 << max(12, min(MOST_CELLS, 8 * grams.count()).bit_length())

    def run(batches):
        for batch in batches:
            hashes = batch.column("gram").to_numpy().view(np.uint64)
            lang = np.array([at[l] for l in batch.column("lang").to_pylist()], np.int64)
            cell = np.concatenate(places(hashes, cells)) * wide + np.tile(lang // 64, PROBES)
            mask = np.tile(np.uint64(1) << (lang % 64).astype(np.uint64), PROBES)
            order = np.argsort(cell, kind="stable")
            cell, mask = cell[order], mask[order]
            begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
            masks = np.bitwise_or.reduceat(mask, begin) if len(begin) else mask
            yield pa.RecordBatch.from_arrays([pa.array(cell[begin]), pa.array(masks.view(np.int64))], names=["cell", "mask"])

    found = grams.select("lang", "gram").mapInArrow(run, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(cells * wide, np.uint64)
    table[found["cell"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    table = table.reshape(cells, wide)
    false = [np.mean(table[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) ** PROBES for k in range(len(names))]
    return Filters(names, table, np.array(false), max(range(len(names)), key=lambda i: (docs[names[i]], -i), default=0))


def remainder(ident: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % of


def fit(labelled: DataFrame, sample: int = DOCS_PER_LANGUAGE) -> Filters:
    """Fit filters on rows of (ident, body, lang); rows without a language are left out.

    About ``sample`` documents of each language, chosen by a hash of id, are counted. What comes to the driver is one
    row per language and the cells of the filters.
    """
    rows = labelled.where("lang is not null")
    common.ship(labelled.sparkSession)
    docs = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not docs:
        return Filters([], np.zeros((1 << 12, 1), np.uint64), np.zeros(0), 0)
    share = F.create_map(*[x for l, n in docs.items() for x in (F.lit(l), F.lit(min(1.0, sample / n)))])
    draw = F.pmod(F.xxhash64(F.col("ident").cast("string"), F.lit(4)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(draw < share[F.col("lang")])

    def count(batches):
        for batch in batches:
            for part in common.slices(batch, "body"):
                names, code = np.unique(np.array(part.column("lang").to_pylist()), return_inverse=True)
                hashes, owner, _ = grams([t or "" for t in part.column("body").to_pylist()])
                for k, lang in enumerate(names.tolist()):
                    gram, n = np.unique(hashes[code[owner] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = chosen.select("ident", "body", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = common.materialise(counted, "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    held = counted.join(totals, "lang").where((F.col("n") >= 2) & (F.col("n") >= F.col("total") * LEAST_RATE))
    return build(common.materialise(held.select("lang", "gram"), "held"), docs)


def identify(docs: DataFrame, filters: Filters, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, lang_pred, score) of every row, from its whole text alone.

    A null text and one without a letter are ``und`` with score 0. A text whose n-grams no filter knows gets the most
    frequent language, with score 0. Equal counts go to the language that sorts first. Rows that repeat an id all come
    back, equal texts with equal results. An empty table gives no rows; without labelled rows all texts are ``und``.
    Other columns, whatever their names, are not read.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "body"):
                lang, score = filters.predict([t or "" for t in part.column("body").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("ident"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[ident, "lang_pred", "score"])

    kind = dict(docs.dtypes)[ident]
    return docs.selectExpr(f"`{ident}` as ident", f"`{text}` as body").mapInArrow(run, f"`{ident}` {kind}, lang_pred string, score double")


def learn(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Fit on the rows whose remainder modulo 3 is not 1."""
    labelled = docs.select(F.col(ident).alias("ident"), F.col(text).alias("body"), F.col(lang).alias("lang"))
    return fit(labelled.where(remainder(F.col("ident"), 3) != 1))


def _accepted(filters: Filters, least: float | None):
    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        batch, found = pa.RecordBatch.from_arrays([texts], names=["body"]), []
        for part in common.slices(batch, "body"):
            lang, score, n = filters.weigh([t or "" for t in part.column("body").to_pylist()])
            fine = (score > least) | (n < LEAST_GRAMS) if least is not None else np.ones(len(n), bool)
            found += [p != UNKNOWN and ok for p, ok in zip(lang, fine.tolist(), strict=True)]
        return pa.array(found, pa.bool_())

    return accepted


def keep_known(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", least: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is in some learned language, with all their columns and without a shuffle.

    With ``least``, the score must exceed it too; 0 rejects texts none of whose n-grams any language contains, which are
    of no learned language. A text of fewer than LEAST_GRAMS n-grams, such as one short word, is too short for that.
    """
    return docs.where(_accepted(learn(docs, ident, text, lang), least)(F.col(text)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = identify(docs, learn(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
