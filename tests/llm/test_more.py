"""Awkward rows, forbidden inputs, exact sets and whole tables."""

from __future__ import annotations

import itertools
import os
import time
import zlib
from array import array

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from deskflow.llm import bpe, common, exact_dedup, language_id, media, mixing, ngram_join, quality, suffix_dedup, token_counts, token_files
from deskflow.llm.tokenizing import ByteEncoder, byte_bpe_path

SF = "/root/testdata/sf0.1"


def test_masks_are_the_exact_sets(spark):
    """No n-gram that a language contains is missing from its filter; others are in it about as often as corrected for."""
    rng = np.random.default_rng(2)
    words = {"en": ["thing", "other", "where"], "fr": ["queux", "leçon", "other"], "de": ["schön", "pfeife", "where"]}
    rows = [(i, " ".join(rng.choice(words[l], 9)), l) for i in range(300) for l in [list(words)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.learn(docs)
    assert filters.languages == ["de", "en", "fr"]
    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    sets = {}
    for lang in words:
        hashes = language_id.grams([t for _, t, l in taught if l == lang])[0]
        value, n = np.unique(hashes, return_counts=True)
        sets[lang] = set(value[n >= 2].tolist())
    known = np.array(sorted(set().union(*sets.values())), np.uint64)
    masks = filters.masks(known)[:, 0]
    for k, lang in enumerate(filters.languages):
        inside = np.array([g in sets[lang] for g in known.tolist()])
        found = (masks >> np.uint64(k) & np.uint64(1)).astype(bool)
        assert found[inside].all() and found[~inside].mean() <= 0.1
        random = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
        rate = (filters.masks(random)[:, 0] >> np.uint64(k) & np.uint64(1)).mean()
        assert abs(rate - filters.false[k]) < 0.01
    texts = [t for _, t, _ in rows]
    for text, lang, score in zip(texts, *filters.predict(texts), strict=True):
        own = language_id.grams([text])[0]
        bits = [max(((filters.masks(own)[:, 0] >> np.uint64(k) & np.uint64(1)).sum() - len(own) * f) / (1 - f), 0) for k, f in enumerate(filters.false)]
        assert lang == filters.languages[int(np.argmax(bits))] and abs(score - max(bits) / sum(bits)) < 1e-9


def test_language_stage_rejects_what_no_language_has(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["thing", "other", "where"], 12)), "en") for i in range(60)]
    rows += [(60, "Re.", "en")]  # too short to tell
    odd = [(100, "ЖЖЖЖ ЪЪЪЪ", None), (101, "漢字漢字漢字", None), (102, None, "en"), (103, "12 !", "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    kept = corpus_pipeline.known_language(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(61)) and language_id.keep_known(docs).count() == 63


def test_predictions_read_texts_only(spark):
    rng = np.random.default_rng(5)
    text = lambda good: " ".join(rng.choice(["plain", "words", "here"] if good else ["##", "||", "x9x"], 15))
    rows = [(i, text(i % 2), "en" if i % 2 else "de", f"s{i % 5}", i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int")
    machine, filters = quality.learn(docs, docs.select("doc_id", "quality")), language_id.learn(docs)
    other = docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("q").alias("source"), (1 - F.col("quality")).alias("quality"))
    for run in (lambda d: quality.score(d, machine), lambda d: language_id.identify(d, filters)):
        a, b = ([tuple(r)[1:] for r in sorted(run(d).collect())] for d in (docs, other))
        assert a == b
    flipped = docs.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.learn(docs, flipped.select("doc_id", "quality"))  # held-out labels aren't learned
    assert np.array_equal(machine.factors, again.factors) and machine.bias == again.bias
    held = language_id.learn(docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "zz").otherwise(F.col("lang"))))
    assert held.languages == ["de", "en"] and np.array_equal(held.cells, filters.cells)


def test_scores_by_brute_force():
    """The whole score of a text, the pairwise term by all pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = pa.array(["Some plain words here.", "## || ##", "", None, "a b a b a b 12!"])
    bag, stats, bucket = quality.features(texts)
    machine = quality.Machine(rng.normal(size=quality.STATS), np.full(quality.STATS, 2.0), 0.3, rng.normal(size=quality.WORDS + quality.STATS + quality.BUCKETS).astype(np.float32), rng.normal(0, 0.3, (quality.WORDS + quality.STATS + quality.BUCKETS, quality.RANK)).astype(np.float32))
    for x, got in zip(machine.inputs(bag, stats, bucket), machine.scores(texts), strict=True):
        at = np.flatnonzero(x)
        logit = machine.bias + sum(float(machine.linear[i] * x[i]) for i in at) + sum(float(machine.factors[i] @ machine.factors[j] * x[i] * x[j]) for i, j in itertools.combinations(at, 2))
        assert abs(got - 1 / (1 + np.exp(-np.clip(logit, -30, 30)))) < 1e-3


def test_many_short_texts_take_little_memory():
    import resource

    import pyarrow as pa

    machine = quality.train(np.zeros((0, quality.WORDS), np.float32), np.zeros((0, quality.STATS)), np.zeros(0, np.int64), np.zeros(0, np.float32))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    batch = pa.RecordBatch.from_arrays([pa.array(["a b"] * 10_000)], names=["body"])
    assert sum(len(machine.scores(p.column("body"))) for p in common.slices(batch, "body", rows=quality.ROWS)) == 10_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB


def test_very_long_texts(spark):
    """One text of 20 million characters among small ones, through the operators that cut texts up."""
    rng = np.random.default_rng(0)
    long = " ".join(rng.choice(["thing", "other", "where", "words"], 3_400_000))[:20_000_000]
    docs = spark.createDataFrame([(1, "a b c d"), (2, long), (3, "thing other")], "doc_id long, text string").withColumn("source", F.lit("s")).cache()
    folder, freq = token_files.token_files(docs, byte_bpe_path())
    got = sorted(tuple(r) for r in token_files.read_blocks(spark, folder, freq).collect())
    coder, start = ByteEncoder.at(byte_bpe_path()), 0
    for row, text in zip(got, ["a b c d", long, "thing other"], strict=True):
        ids = [*np.frombuffer(coder.encode([text])[0], coder.dtype).tolist(), 0]
        assert row[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    blocks = spark.read.parquet(folder).where("array_contains(doc_ids, 2)")
    assert blocks.count() > 100 and blocks.agg(F.max("n_ids")).first()[0] == token_files.BLOCK_IDS
    words = len(long.split())
    assert {r.doc_id: r.size for r in mixing.mix_sources(docs).collect()} == {1: 4, 2: words, 3: 2}
    assert {r.doc_id: r.n_shingles for r in ngram_join.ngram_join(docs).collect()}[2] == len(set(zip(long.split(), long.split()[1:], long.split()[2:], strict=False)))
    assert {r.doc_id: r.kept for r in exact_dedup.exact_dedup(docs).collect()} == {1: True, 2: True, 3: True}
    assert [r.n_bytes for r in media.media_digests(media.with_media(docs)).orderBy("doc_id").collect()] == [7, 20_000_000, 11]
    assert [r.n_tokens for r in token_counts.token_lengths(docs, byte_bpe_path()).orderBy("doc_id").collect()] == [g[2] - 1 for g in got]
    assert bpe.encode_texts(docs, bpe.word_bpe_path()).where("doc_id = 2").select(F.size("ids")).first()[0] >= words
    assert quality.score(docs, quality.train(np.zeros((0, quality.WORDS), np.float32), np.zeros((0, quality.STATS)), np.zeros(0, np.int64), np.zeros(0, np.float32))).count() == 3
    assert language_id.identify(docs, language_id.learn(docs.withColumn("lang", F.lit("en")))).count() == 3
    piece = spark.createDataFrame([(1, long[:3_000_000] + "#" * 500), (2, "#" * 450 + long[3_000_000:3_000_900])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(piece).collect()} == {1: 500, 2: 450}


def test_parts_of_documents_have_one_crc():
    rng = np.random.default_rng(1)
    for _ in range(30):
        parts = [rng.bytes(int(n)) for n in rng.integers(0, 70_000, 4)]
        rest, crc = sum(map(len, parts)), 0
        for p in parts:
            rest -= len(p)
            crc ^= token_files.crc_after(zlib.crc32(p), rest)
        assert crc == zlib.crc32(b"".join(parts))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_every_text_has_the_library_ids():
    coder = ByteEncoder.at(byte_bpe_path())
    texts = [t or "" for t in pd.read_parquet(f"{SF}/documents.parquet", columns=["text"]).text]
    assert coder.ranks is not None and len(texts) >= 10_000
    for at in range(0, len(texts), 1000):
        assert coder.encode(texts[at : at + 1000]) == coder.library_ids(texts[at : at + 1000])


def test_encoding_costs_less_than_the_published_pattern():
    """Before, encoding cost as much as with the published pattern, whose alternatives are tried one by one."""
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("aeioubrstlénm"), n)) + "," * int(n % 7 == 0) for n in rng.integers(2, 11, 400)) for _ in range(150)]
    texts += [t.replace(" lo", "\n\n lo") for t in texts]
    coder = ByteEncoder.at(byte_bpe_path())
    published = tiktoken.Encoding("published", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks._mergeable_ranks, special_tokens={})

    def whole(texts):
        return [array(coder.code, published.encode_ordinary(t)).tobytes() for t in texts]

    def seconds(run):
        began = time.process_time()
        run(texts)
        return time.process_time() - began

    assert coder.encode(texts) == whole(texts)
    own, plain = zip(*[(seconds(coder.encode), seconds(whole)) for _ in range(9)], strict=True)
    assert min(own) < 0.85 * min(plain)


def test_runs_of_white_space():
    """All 25 characters of white space, alone and in runs, beside some that only look like it."""
    rng = np.random.default_rng(6)
    space = [*"\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
    parts = [*space, *"aé1²'!中\0\x1c\u180e\u200b\u0301", "'s", "'re", "x y", "<|none|>", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, n)) for n in rng.integers(0, 12, 20_000)] + [f"a{s}b" for s in space] + [f"a{s}{t}b{s}{t}" for s in space for t in space]
    coder = ByteEncoder.at(byte_bpe_path())
    assert len(space) == 25 and coder.encode(texts) == coder.library_ids(texts)


def test_blocks_are_those_of_a_scalar_coder():
    rng = np.random.default_rng(7)
    blocks = [rng.geometric(0.05, n).clip(0, 99) for n in (0, 1, 33, 4096, 5000, 8200)]
    counts = np.bincount(np.concatenate(blocks), minlength=100)
    freq = token_files.frequencies({i: int(n) for i, n in enumerate(counts) if n}, 100)
    start = (np.cumsum(freq) - freq).tolist()
    coder = token_files.Coder(freq)
    for ids, coded in zip(blocks, coder.encode(blocks), strict=True):
        state, words, points = [token_files.LOW] * 32, [], []
        for i in range(len(ids) - 1, -1, -1):
            f, x = int(freq[ids[i]]), state[i % 32]
            if x >= f << 43:
                words.append(x & 0xFFFFFFFF)
                x >>= 32
            state[i % 32] = (x // f << 20) + x % f + start[ids[i]]
            if i % 4096 == 0:
                points.append((len(words), list(state)))
        marks = b"".join(np.array(len(words) - at, "<u4").tobytes() + np.array(x, "<u8").tobytes() for at, x in points[::-1])
        head = b"RNS1" + np.array([coder.crc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(words), len(points)], "<u4").tobytes()
        assert coded == head + marks + np.array(words[::-1], "<u4").tobytes()


CLASH = "doc_id long, text string, lang string, source string, ident string, body string, n int, ids string, shard int, cell int, mask int, gram int, media string, codec string, seconds string, score string, size string, q int, u int, part int"


def test_clashing_columns_everywhere(spark):
    rows = [(i, f"thing other {i % 3} where words", "en", "s", *["x"] * 2, 1, "x", *[1] * 4, *["x"] * 5, *[1] * 3) for i in range(9)]
    docs = spark.createDataFrame(rows + [(None, None, None, None, *["x"] * 2, 1, "x", *[1] * 4, *["x"] * 5, *[1] * 3)], CLASH)
    folder, freq = token_files.token_files(docs, byte_bpe_path())
    results = [
        exact_dedup.exact_dedup(docs),
        quality.score(docs, quality.learn(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))),
        language_id.identify(docs, language_id.learn(docs)),
        bpe.digests(bpe.decode_ids(bpe.encode_texts(docs, bpe.word_bpe_path()), bpe.word_bpe_path())),
        token_files.read_blocks(spark, folder, freq),
        mixing.mix_sources(docs),
        media.media_digests(media.with_media(docs)),
        token_counts.token_lengths(docs, byte_bpe_path()),
    ]
    assert [r.count() for r in results] == [10] * len(results)


def test_stages_on_awkward_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, head string"
    text = "thing other where words thing there other were word"
    rows = [(i, f"{text} {i} tail{i} end{i} more{i}", "en", "s", 1, "x", "y") for i in range(12)]
    rows += [rows[0], (50, rows[1][1], "en", None, None, "x", "y"), (None, "thing other where null id", "en", None, 1, "x", "y"), (None, "thing other where second null id", None, "s", 1, "x", "y")]
    rows += [(3, "thing other where the same id again", "en", "s", 1, "x", "y"), (60, None, "en", "s", 0, "x", "y"), (61, "", None, None, None, "x", "y"), (62, "thing other words " * 30_000, "en", "s", 1, "x", "y")]
    for table in ([], rows):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.materialise(stage(spark, docs, ""), f"test-{name}")
            assert docs.columns == schema.replace(",", "").split()[::2]
            if name == "exact_dedup" and table:
                assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(map(str, [*range(12), 3, 62, None, None]))
        out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert len(out) == docs.count() and bool(out) == bool(table)


def test_one_pass_equals_two(spark):
    docs = spark.createDataFrame([(1, "Some words, <unk> 日本語"), (2, None), (3, ""), (None, "x" * 5000), (1, " a\n\tb ")], "doc_id long, text string")
    path = bpe.word_bpe_path()
    one, two = bpe.encode_texts(docs, path, decode=True), bpe.decode_ids(bpe.encode_texts(docs, path), path)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == 5
