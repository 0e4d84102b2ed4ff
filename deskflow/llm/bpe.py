"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many different words stand in one flat array. A round forms the key (left id * vocabulary + right id)
of every adjacent pair, finds its rank by binary search over the sorted keys of all merges, takes each word's lowest
rank and merges all its occurrences, left to right; finished words leave the array. Texts are cut at white space
first, which no word crosses, and a bounded cache keeps the ids of chunks met before, so only new words are merged.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskflow.llm import common
from deskflow.llm.tokenizing import byte_letters

CACHED = 250_000  # chunks kept by a worker while it runs a task
MERGED_SYMBOLS = 1_000_000  # symbols in one flat array
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = "\x1c\x1d\x1e\x1f"  # str.split() takes these for white space, the tokenizer does not
_BY_PATH: dict[str, WordBpe] = {}


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """A lower-casing BPE with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        model = plan["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in plan["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.base = size
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + self.suffix] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.pattern = regex.compile(plan["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.ids: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> WordBpe:
        if path not in _BY_PATH:
            _BY_PATH[path] = cls(path)
        return _BY_PATH[path]

    def merge_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = []
        raw = [w.encode() for w in words]
        at = 0
        while at < len(raw):
            n, end = 0, at
            while end < len(raw) and (end == at or n + len(raw[end]) <= MERGED_SYMBOLS):
                n, end = n + len(raw[end]), end + 1
            out += self._merge(raw[at:end])
            at = end
        return out

    def _merge(self, raw: list[bytes]) -> list[np.ndarray]:
        size = np.array([len(r) for r in raw])
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), size)
        result: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raw)
        none = len(self.ranks)
        while len(symbols):
            rank = np.full(len(symbols), none)
            near = np.flatnonzero(owner[:-1] == owner[1:])
            key = symbols[near] * self.base + symbols[near + 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            rank[near[hit]] = self.ranks[place[hit]]
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, begin)
            span = np.diff(np.r_[begin, len(symbols)])
            done = lowest == none
            if done.any():  # their symbols are final
                for w, a, n in zip(owner[begin[done]].tolist(), begin[done].tolist(), span[done].tolist(), strict=True):
                    result[w] = symbols[a : a + n]
                stay = np.repeat(~done, span)
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                lowest, span = lowest[~done], span[~done]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == np.repeat(lowest, span))
            # Of pairs that overlap (the same symbol repeated) every other one is merged, from the left.
            run = np.r_[True, (np.diff(chosen) != 1) | (owner[chosen[1:]] != owner[chosen[:-1]])]
            first = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            symbols[chosen] = self.made[rank[chosen]]
            left = np.ones(len(symbols), bool)
            left[chosen + 1] = False
            symbols, owner = symbols[left], owner[left]
        return result

    def _words(self, chunk: str) -> list[str | int]:
        """Words of a chunk without white space, and the ids of special tokens in it."""
        found: list[str | int] = []
        for part in self.split_special.split(chunk) if self.split_special and "<" in chunk else [chunk]:
            if part in self.special:
                found.append(self.special[part])
            elif part.isascii():
                found += self.pattern.findall(part.lower())
            else:
                found += self.pattern.findall("".join([c.lower() for c in unicodedata.normalize("NFC", part)]))
        return found

    def _learn(self, chunks: set[str]) -> None:
        if len(self.ids) > CACHED:
            self.ids = {}
        new = [c for c in chunks if c not in self.ids]
        parts = [self._words(c) for c in new]
        words = list({w for p in parts for w in p if isinstance(w, str)})
        ids = {w: i.astype("<i4").tobytes() for w, i in zip(words, self.merge_words(words), strict=True)}
        for c, p in zip(new, parts, strict=True):
            self.ids[c] = b"".join([ids[w] if isinstance(w, str) else np.array([w], "<i4").tobytes() for w in p])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [[c for c in _SPACE.split(t) if c] if any(o in t for o in _ODD) else t.split() for t in texts]
        chunks: set[str] = set()
        for s in split:
            chunks.update(s)
        self._learn(chunks)
        get = self.ids.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens on end with single spaces, as the library does for a file without a decoder; unknown ids are left out."""
        return " ".join([self.tokens[i] for i in ids.tolist() if i < self.base])


def _arrays(coder: WordBpe, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts on end, and where each text's end."""
    ids = coder.encode([t or "" for t in texts.to_pylist()])
    return np.frombuffer(b"".join(ids), "<i4"), np.cumsum([0, *[len(i) // 4 for i in ids]]).astype(np.int32)


def _texts(names: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Tokens on end with single spaces, as the library decodes for a file without a decoder."""
    tokens = names[ids].tolist()
    return pa.array([" ".join(tokens[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())


def encode_texts(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """(ident, ids array<int>) of every row, with ``decode`` also ``decoded``, the text that its ids give.

    A null or empty text has no ids. Texts of any length are read whole, words of more than MERGED_SYMBOLS bytes in an
    array of their own. Rows that repeat an id, or have none, all come back. An empty table gives no rows; other columns
    are not read.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        coder = WordBpe.at(path)
        names = np.array(coder.tokens, object)
        for batch in batches:
            for part in common.slices(batch, "body"):
                ids, ends = _arrays(coder, part.column("body"))
                columns = [part.column("ident"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, *([_texts(names, ids, ends)] if decode else [])], names=[ident, "ids", *(["decoded"] if decode else [])])
        coder.ids = {}  # workers are kept for later stages

    kind = dict(docs.dtypes)[ident]
    return docs.selectExpr(f"`{ident}` as ident", f"`{text}` as body").mapInArrow(run, f"`{ident}` {kind}, ids array<int>" + (", decoded string" if decode else ""))


def decode_ids(tokens: DataFrame, path: str, ident: str = "doc_id") -> DataFrame:
    """(ident, ids, decoded) of rows with ids; null ids decode to the empty text."""
    common.ship(tokens.sparkSession)

    def run(batches):
        names = np.array(WordBpe.at(path).tokens, object)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = part.column("ids")
                ends = np.r_[0, np.cumsum([len(x) if x.is_valid else 0 for x in column])]
                yield pa.RecordBatch.from_arrays([part.column(0), column, _texts(names, column.flatten().to_numpy(), ends)], names=[ident, "ids", "decoded"])

    kind = dict(tokens.dtypes)[ident]
    return tokens.select(ident, "ids").mapInArrow(run, f"`{ident}` {kind}, ids array<int>, decoded string")


def digests(coded: DataFrame, ident: str = "doc_id") -> DataFrame:
    return coded.select(
        ident,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_texts(common.documents(spark, sf_dir), word_bpe_path(), decode=True))
