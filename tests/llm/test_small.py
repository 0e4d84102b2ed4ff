"""Each corpus operator on small awkward tables, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskflow.llm import bpe, exact_dedup, language_id, media, mixing, ngram_join, quality, suffix_array, suffix_dedup, token_counts, token_files
from deskflow.llm.tokenizing import ByteEncoder, byte_bpe_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, n string, body string, h string, label int"
WORDS = "the of and to in er on an re th ing ed le la que de die und der los".split()


def make(rng, n, size=40):
    return " ".join(rng.choice(WORDS, n % size + 1))


def table():
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(WORDS, 80)) + f" tail{i}" for i in range(4)]
    texts = [None, "", "  \t\n", "A b", "a  B", "one", "x" * 9000, "ab " * 700, "日本語 テスト 🙂 é é", "!!! ??? 123", base[0] + "\n" + base[1], base[1] + " <|endoftext|> " + base[0]]
    texts += base + [base[0], base[0].upper(), base[0] + " ", base[2].replace(" the ", " thx ", 1), base[3][:-1]] + [make(rng, i) for i in range(20)]
    texts += [base[2] + f" k{i}" for i in range(6)] + ["same words here"] * 5
    langs, sources = ["en", "fr", None], ["s2", None, "s1", ""]
    rows = [(i * 3 % 997, t, langs[i % 3], sources[i % 4], None if i % 5 == 0 else 1, "x", "x", "x", "x", 0) for i, t in enumerate(texts)]
    return rows + [rows[12]]  # a row twice


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(frame):
    return frame


def test_empty_tables(spark, nothing):
    results = [
        exact_dedup.exact_dedup(nothing),
        exact_dedup.keep_one(nothing),
        ngram_join.ngram_join(nothing),
        ngram_join.keep_one(nothing),
        mixing.mix_sources(nothing),
        mixing.take_copies(nothing),
        media.media_digests(media.with_media(nothing)),
        token_counts.length_histogram(token_counts.token_lengths(nothing, byte_bpe_path())),
        bpe.digests(bpe.decode_ids(bpe.encode_texts(nothing, bpe.word_bpe_path()), bpe.word_bpe_path())),
        language_id.identify(nothing, language_id.learn(nothing)),
        language_id.keep_known(nothing),
        quality.score(nothing, quality.learn(nothing, spark.createDataFrame([], "doc_id long, quality int"))),
        suffix_dedup.remove_repeats(nothing),
    ]
    assert [r.count() for r in results] == [0] * len(results)
    folder, freq = token_files.token_files(nothing, byte_bpe_path())
    assert token_files.read_blocks(spark, folder, freq).count() == 0


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d e"), (None, None), (1, "a b c d e")], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(rows).where("group_size = 2").collect()} == {(None, 1, False), (1, 1, True)}
    assert sorted(str(r.component_id) for r in ngram_join.ngram_join(rows).collect()) == ["1", "None", "None"]
    assert mixing.mix_sources(rows).count() == 3 and suffix_dedup.remove_repeats(rows).count() == 3


def test_keep_one_by_text(spark):
    """Null and repeated ids with different texts: one row of each class stays, and no row goes for want of an id."""
    schema = "doc_id long, text string"
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (None, "ghi jkl"), (1, "m n o p q r"), (1, "s t u v w x"), (0, "stu vwx"), (0, "s t  u v w x y"), (2, "mnopqr")]
    got = sorted(map(str, (squeeze(r.text) for r in exact_dedup.keep_one(spark.createDataFrame(rows, schema)).collect())))
    assert got == sorted({squeeze(t) for _, t in rows})
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (3, "g h i j k l"), (4, "g h i j k l")]
    got = sorted(map(str, (tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(rows, schema)).collect())))
    assert got == sorted(map(str, rows[:3]))


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup(docs):
    rows, got = docs.collect(), exact_dedup.exact_dedup(docs).collect()
    classes = {}
    for r in rows:
        classes.setdefault(squeeze(r.text), []).append((-len(r.text or ""), r.doc_id))
    want = sorted((r.doc_id, min(c)[1], len(c), min(c)[1] == r.doc_id, hashlib.sha256(squeeze(r.text).encode()).hexdigest()) for r in rows for c in [classes[squeeze(r.text)]])
    assert sorted(tuple(r) for r in got) == want
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(classes)


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return set(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("words, share", [(3, (90, 100)), (5, (80, 100)), (2, (50, 100))])
def test_ngram_join(docs, words, share):
    sets = {r.doc_id: shingles(r.text, words) for r in docs.collect()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if (both := len(sets[a] & sets[b])) and share[1] * both >= share[0] * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {d: (len(s), find(d)) for d, s in sets.items()}
    got = ngram_join.ngram_join(docs, words, share).collect()
    assert len(got) == docs.count() and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert ngram_join.keep_one(docs, words, share).select("doc_id").distinct().count() == len({c for _, c in want.values()})


def test_near_copies_of_near_copies(spark):
    """A chain and a star of edits: components need links that a single pivot doesn't see."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 1000, 60)]
    texts = []
    for i in range(120):
        t = list(base)
        for j in rng.integers(0, 60, rng.integers(0, 4)):
            t[j] = f"v{rng.integers(0, 6)}"
        texts.append(" ".join(t))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
    assert sorted(tuple(r) for r in ngram_join.ngram_join(rows).collect()) == sorted(con.execute(ngram_join.SQL).fetchall())


@pytest.mark.parametrize("words, share", [(3, (90, 100)), (5, (80, 100)), (2, (50, 100))])
@pytest.mark.parametrize("block", [256, 2])
def test_ngram_links(spark, docs, words, share, block, monkeypatch):
    """Every link counts, also between documents that one pivot has put into the same component."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base = [f"w{i}" for i in range(60)]
    extra = [(3000 + i, " ".join([*base, f"v{i}"])) for i in range(12)] + [(4000, None), (None, " ".join(base))]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    sets = {r.doc_id: shingles(r.text, words) for r in rows.where("doc_id is not null").collect()}
    count = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sets, 2):
        if (both := len(sets[a] & sets[b])) and share[1] * both >= share[0] * len(sets[a] | sets[b]):
            count[a] += 1
            count[b] += 1
    got, joined = ngram_join.ngram_links(rows, words, share).collect(), ngram_join.ngram_join(rows, words, share).collect()
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, (tuple(r) for r in joined)))
    assert {r.doc_id: r.n_links for r in got} == {**count, None: None} and all(count[3000 + i] == 11 for i in range(12))


def test_mixing(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").dropDuplicates(["doc_id"]).toArrow())
    got = mixing.mix_sources(docs.dropDuplicates(["doc_id"])).select("doc_id", "size", "source_size", "target", "taken", "copies")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, con.execute(f"SELECT doc_id, size, source_size, target, taken, copies FROM ({mixing.SQL})").fetchall()))
    rows = got.collect()
    assert all(r.taken <= 2 * r.size for r in rows) and got.collect() == rows
    copies = mixing.take_copies(docs.dropDuplicates(["doc_id"]))
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in rows)


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 10, 1)], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 20 and abs(sum(got.values()) - 1.5 * 2020) < 1e-6 and got["b"] <= 2000 and got["c"] <= 2000


def test_media(docs):
    got = {(r.doc_id, r.n_bytes): r for r in media.media_digests(media.with_media(docs)).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        g = got[r.doc_id, len(raw)]
        assert (g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = media.mux(padded)
        assert (g.media_bytes, g.media_sha256, g.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(stored))
    stored = media.mux(bytes(range(256)) * 20)
    codec, seconds, ranges = media.describe(stored)
    assert (codec, seconds, len(ranges)) == ("raw ", 5120 / 8000, 5) and b"".join(stored[a:b] for a, b in ranges) == bytes(range(256)) * 20
    assert media.describe(b"") == ("none", 0.0, []) and media.describe(stored[:50]) == ("none", 0.0, [])


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_bpe(docs):
    path = bpe.word_bpe_path()
    lib = library(path)
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.digests(bpe.decode_ids(bpe.encode_texts(docs, path), path)).collect()}
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()]
        assert (g.n_tokens, g.decoded_sha256) == (len(ids), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())


AWKWARD = ["a  b", " a", "a ", "\n", "x\n y", "don't 'sam !'s I'LL", "a\x1cb c\x85d", "<|endoftext|> a<|endoftext|>b", "tab\tx y z　q w", "\U0001f600‍", "aaaa" * 50 + "!" * 30, "ΑΣ ΌΣΟΣ İI", "½ 123٣", "﻿x", "é ñ"]


def test_awkward_texts():
    word, byte = bpe.WordBpe.at(bpe.word_bpe_path()), ByteEncoder.at(byte_bpe_path())
    for text in AWKWARD:
        assert np.frombuffer(word.encode([text])[0], "<i4").tolist() == library(bpe.word_bpe_path()).encode(text, add_special_tokens=False).ids, text
        assert np.frombuffer(byte.encode([text])[0], byte.dtype).tolist() == library(byte_bpe_path()).encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, docs):
    lib = library(byte_bpe_path())
    folder, freq = token_files.token_files(docs.dropDuplicates(["doc_id"]), byte_bpe_path())
    assert freq.sum() == 1 << token_files.SCALE
    got, start = sorted(tuple(r) for r in token_files.read_blocks(spark, folder, freq).collect()), 0
    rows = sorted(docs.dropDuplicates(["doc_id"]).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(rows)
    for g, r in zip(got, rows, strict=True):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert g == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_rans_round_trip():
    rng = np.random.default_rng(5)
    blocks = [rng.geometric(p, n).clip(0, 999) for p, n in ((0.5, 1), (0.1, 40_000), (0.01, 32), (0.3, 4097), (0.9, 128 * 32))]
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(np.concatenate(blocks), return_counts=True)), strict=True))
    coder = token_files.Coder(token_files.frequencies(counts, 1000))
    coded = coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, coder.decode(coded), strict=True))
    broken = bytearray(coded[1])
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        coder.decode([bytes(broken)])


def test_token_counts(spark, docs):
    lib = library(byte_bpe_path())
    n = np.array([len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()])
    histogram = token_counts.length_histogram(token_counts.token_lengths(docs, byte_bpe_path())).cache()
    for r in histogram.collect():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.kept_at_limit) == ((n == r.n_tokens).sum(), (n >= r.n_tokens).sum(), n[n >= r.n_tokens].sum(), np.minimum(n, r.n_tokens).sum())
        assert r.rank == (n <= r.n_tokens).mean()
    for limit in (0, 7, 100, 10**6):
        assert token_counts.truncated_total(histogram, limit).first().truncated_tokens == np.minimum(n, limit).sum()
    assert token_counts.quantile(histogram, 0.5).first().n_tokens == np.sort(n)[-(-len(n) // 2) - 1]


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for t in range(150):
        d = rng.integers(0, rng.integers(1, 5), rng.integers(0, 70)).astype(np.uint8)
        if t % 3 == 0:
            d = np.r_[d, d[: len(d) // 2], d]
        sa = suffix_array.suffix_array(d)
        b = d.tobytes()
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        lcp = suffix_array.permuted_lcp(d, sa)
        for i, k in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            n = next((j for j in range(len(b)) if i + j >= len(b) or k + j >= len(b) or b[i + j] != b[k + j]), 0)
            assert lcp[i] == n


@pytest.mark.parametrize("hot", [400, 2])
def test_suffix_dedup(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(8)
    passage = " ".join(rng.choice(WORDS, 160))
    extra = [(2000 + i, make(rng, 30) + passage[i * 3 : 430 + i * 17] + make(rng, 39)) for i in range(12)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = [(r.doc_id, (r.text or "").encode()) for r in rows.collect()]
    seen = {}
    for _, b in texts:
        for k in range(len(b) - 399):
            seen[b[k : k + 400]] = seen.get(b[k : k + 400], 0) + 1
    want = []
    for i, b in texts:
        inside = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                inside[k : k + 400] = True
        edges = np.diff(np.r_[0, inside.astype(int), 0])
        want.append((i, len(b), int(inside.sum()), int((edges == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~inside])))
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(rows).collect()]
    assert sorted(got) == sorted(want) and any(0 < w[2] < w[1] for w in want)


def test_language_and_quality(spark):
    rng = np.random.default_rng(1)
    words = {"en": ["thing", "other", "where", "sheath"], "fr": ["queux", "étaient", "leçon", "oiseau"], "de": ["schön", "pfeife", "über", "ungern"]}
    rows = [(i, " ".join(rng.choice(words[l], 12)) + ("" if i % 2 else " ###***|||" * 4), l, i % 2) for i in range(300) for l in [["en", "fr", "de"][i % 3]]]
    rows += [(1000, None, "en", None), (1001, "", "fr", None), (1002, "123 !!", "de", None), (1003, "zzz qqq xxx", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert all(got[i].lang_pred == l and 0 <= got[i].score <= 1 for i, _, l, _ in rows[:300])
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in words
    assert language_id.keep_known(docs).count() == 301
    machine = quality.learn(docs, docs.select("doc_id", "quality"))
    scores = {r.doc_id: r.score for r in quality.score(docs, machine).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1000] == scores[1001]
    assert np.mean([(scores[i] >= 0.7) == bool(q) for i, _, _, q in rows[:300]]) > 0.95
    x = np.random.default_rng(0).normal(size=(3, quality.WORDS + quality.STATS + quality.BUCKETS)).astype(np.float32)
    pairs = [sum(float(machine.factors[i] @ machine.factors[j]) * float(r[i] * r[j]) for i, j in itertools.combinations(np.flatnonzero(np.abs(r) > 2.4), 2)) for r in x]
    sparse = np.where(np.abs(x) > 2.4, x, 0)
    assert np.allclose(machine.logits(sparse), machine.bias + sparse @ machine.linear + pairs, rtol=1e-3, atol=1e-2)
