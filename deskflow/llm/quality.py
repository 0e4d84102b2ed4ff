"""Quality classifier: a factorisation machine over hashed words, structure statistics and length buckets.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise term is computed in linear time as
half the difference of the squared sums and the sums of squares. The model is fitted on a bounded sample of labelled
rows; scoring is one pass over the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskflow.llm import common
from deskflow.llm.language_id import remainder

WORDS, BUCKETS, RANK = 2048, 24, 8
SAMPLE = 8000  # expected number of labelled rows that the model is fitted on
EPOCHS, RATE, DECAY, SEED = 12, 0.03, 1e-5, 11
STATS = 20
ROWS = 500  # texts whose inputs, about 8 KB each, are held at once


def _share(raw: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(raw)]
    return (total[ends[1:]] - total[ends[:-1]]) / np.maximum(size, 1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed words with rows of length 1, raw statistics, length bucket) of each text; null counts as empty."""
    raw, off = common.utf8(texts)
    hashes, owner, begin = common.words(raw, off)
    n, size = len(off) - 1, np.diff(off)
    counts = np.bincount(owner, minlength=n)
    bag = np.bincount(owner * WORDS + (hashes & np.uint64(WORDS - 1)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS).astype(np.float32)
    bag = np.sqrt(bag)
    top = bag.max(1) ** 2
    bag /= np.maximum(np.sqrt((bag**2).sum(1, keepdims=True)), 1e-6)
    order = np.lexsort((hashes, owner))
    fresh = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])][: len(order)]
    kinds = np.bincount(owner[order][fresh], minlength=n)
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])][: len(hashes)]
    gap = np.r_[False, False, (hashes[2:] == hashes[:-2]) & (owner[2:] == owner[:-2])][: len(hashes)]
    prior = np.maximum(begin - 2, 0)
    tail = (begin > 1) & np.isin(raw[prior], np.frombuffer(b"!#$%&*|@^~<>=+_", np.uint8)) if len(begin) else np.zeros(0, bool)
    lines = _share(raw == 10, off, size) * size
    words = np.maximum(counts, 1)
    is_in = lambda chars: np.isin(raw, np.frombuffer(chars, np.uint8))
    columns = [
        np.log1p(size),
        np.log1p(counts),
        size / words,
        _share((raw >= 65) & (raw <= 90), off, size),
        _share((raw >= 48) & (raw <= 57), off, size),
        _share(is_in(b".,;:"), off, size),
        _share(is_in(b"!?"), off, size),
        _share(is_in(b"#$%&*@^~<>=+_"), off, size),
        _share(is_in(b"|"), off, size),
        _share(is_in(b"/\\{}[]()\"'"), off, size),
        _share(raw >= 128, off, size),
        _share((raw < 32) & (raw != 10), off, size),
        lines / words,
        kinds / words,
        top / words,
        np.bincount(owner, weights=same, minlength=n) / words,
        np.bincount(owner, weights=gap, minlength=n) / words,
        np.bincount(owner, weights=tail, minlength=n) / words,
        (size == 0) * 1.0,
        np.minimum(counts, 10) / 10,
    ]
    bucket = np.minimum(np.floor(np.log2(size + 1)).astype(np.int64), BUCKETS - 1)
    return bag, np.stack(columns, 1), bucket


@dataclass
class Machine:
    mean: np.ndarray
    spread: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def inputs(self, bag: np.ndarray, stats: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) / 2
        return np.hstack([bag, scaled.astype(np.float32), np.eye(BUCKETS, dtype=np.float32)[bucket]])

    def logits(self, x: np.ndarray) -> np.ndarray:
        sums = x @ self.factors
        pairs = 0.5 * ((sums**2).sum(1) - (x**2) @ (self.factors**2).sum(1))
        return self.bias + x @ self.linear + pairs

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.inputs(*features(texts))).astype(np.float64), -30, 30)))


def train(bag: np.ndarray, stats: np.ndarray, bucket: np.ndarray, label: np.ndarray) -> Machine:
    """Logistic loss, minibatches, Adam; a fixed seed and the rows' order fix the result. No rows give score 0.5."""
    rng, width = np.random.default_rng(SEED), WORDS + STATS + BUCKETS
    m = Machine(np.zeros(STATS), np.ones(STATS), 0.0, np.zeros(width, np.float32), rng.normal(0, 0.05, (width, RANK)).astype(np.float32))
    if not len(label):
        m.factors[:] = 0
        return m
    m.mean, m.spread = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    x = m.inputs(bag, stats, bucket)
    rate = min(max(label.mean(), 1e-3), 1 - 1e-3)
    m.bias = float(np.log(rate / (1 - rate)))
    state = [np.zeros_like(m.linear), np.zeros_like(m.linear), np.zeros_like(m.factors), np.zeros_like(m.factors), 0.0, 0.0]
    step = 0
    for epoch in range(EPOCHS):
        pace = RATE * 0.5 ** (epoch / 4)
        order = rng.permutation(len(label))
        for a in range(0, len(order), 256):
            rows = order[a : a + 256]
            xb = x[rows]
            p = 1 / (1 + np.exp(-np.clip(m.logits(xb), -30, 30)))
            g = ((p - label[rows]) / len(rows)).astype(np.float32)
            sums = xb @ m.factors
            down = [xb.T @ g + DECAY * m.linear, xb.T @ (sums * g[:, None]) - ((xb**2).T @ g)[:, None] * m.factors + DECAY * m.factors, g.sum()]
            step += 1
            for k, (name, d) in enumerate(zip(("linear", "factors", "bias"), down, strict=True)):
                state[2 * k] = 0.9 * state[2 * k] + 0.1 * d
                state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * d * d
                move = pace * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-7)
                setattr(m, name, getattr(m, name) - move)
    return m


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on rows of (ident, body, label); rows with another label than 0 or 1 are left out.

    The caller bounds the rows; their inputs, about 2 KB each, come to the driver, which trains.
    """

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "body", rows=ROWS):
                bag, stats, bucket = features(part.column("body"))
                rows = []
                for words, s in zip(bag, stats, strict=True):
                    at = np.flatnonzero(words)
                    rows.append(at.astype("<u2").tobytes() + words[at].astype("<f2").tobytes() + s.astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("ident"), part.column("label"), pa.array(bucket), pa.array(rows, pa.binary())], names=["ident", "label", "bucket", "packed"])

    rows = sorted(labelled.select("ident", "label", "body").mapInArrow(run, "ident string, label int, bucket long, packed binary").collect(), key=lambda r: (r.ident, bytes(r.packed)))
    bag = np.zeros((len(rows), WORDS), np.float32)
    stats = np.zeros((len(rows), STATS))
    for i, r in enumerate(rows):
        n = (len(r.packed) - 4 * STATS) // 4
        bag[i, np.frombuffer(r.packed, "<u2", n)] = np.frombuffer(r.packed, "<f2", n, 2 * n)
        stats[i] = np.frombuffer(r.packed, "<f4", STATS, 4 * n)
    return train(bag, stats, np.array([r.bucket for r in rows], np.int64), np.array([r.label for r in rows], np.float32))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, ident: str = "doc_id", text: str = "text") -> Machine:
    """Fit on about ``sample`` labelled rows whose remainder modulo 4 is not 2, chosen by a hash of the id.

    Labels other than 0 and 1, or without an id, are left out; of several labels of an id the greatest counts. Without
    any label every score is 0.5.
    """
    common.ship(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("string").alias("of"), F.col("quality").cast("int").alias("label"))
    marked = marked.where(F.col("of").isNotNull() & F.col("label").isin(0, 1) & (remainder(F.col("of"), 4) != 2))
    n = marked.count()
    draw = F.pmod(F.xxhash64("of", F.lit(2)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = marked.where(draw < min(1.0, sample / max(n, 1))).groupBy("of").agg(F.max("label").alias("label"))
    body = docs.select(F.col(ident).cast("string").alias("ident"), F.col(text).alias("body"))
    # The chosen labels are bounded by ``sample``, at some 20 bytes each, so they may be broadcast at any size.
    return fit(body.join(F.broadcast(chosen), F.col("ident") == F.col("of")), sample)


def score(docs: DataFrame, machine: Machine, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, score) of every row, from its whole text and nothing else.

    Null and empty texts get the score of the empty text; texts of any length are read whole. Rows that repeat an id all
    come back, equal texts with equal scores; a null id comes back null. An empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "body", rows=ROWS):
                yield pa.RecordBatch.from_arrays([part.column("ident"), pa.array(machine.scores(part.column("body")))], names=[ident, "score"])

    kind = dict(docs.dtypes)[ident]
    return docs.selectExpr(f"`{ident}` as ident", f"`{text}` as body").mapInArrow(run, f"`{ident}` {kind}, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    machine = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, machine)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
