"""Large groups of nearly equal documents: nothing is lost, and work grows with the group, not with its square."""

from __future__ import annotations

from contextlib import contextmanager
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskflow.llm import common, mixing, ngram_join, suffix_dedup


def family(n, seed, size=200, edits=3, words=100_000):
    """Texts that differ from one base, which is none of them, in a few places."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 1000, size)]
    out = []
    for _ in range(n):
        t = list(base)
        for j in rng.choice(size, edits, replace=False):
            t[j] = f"v{rng.integers(0, words)}"
        out.append(" ".join(t))
    return out


def wanted(texts):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
    return sorted(con.execute(ngram_join.SQL).fetchall())


def components(texts, words, percent):
    """(row, least row that links reach), from a matrix of shared n-grams."""
    sets = [{tuple(t.split()[i : i + words]) for i in range(len(t.split()) - words + 1)} for t in texts]
    names = {g: i for i, g in enumerate(set().union(*sets))}
    inside = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        inside[i, [names[g] for g in s]] = 1
    both, size = inside @ inside.T, inside.sum(1)
    link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    label = np.arange(len(sets))
    while True:
        new = np.where(link, label[None, :], len(sets)).min(1)
        if (new == label).all():
            return list(enumerate(label.tolist()))
        label = new


@pytest.mark.parametrize("few", [64, 1])
@pytest.mark.parametrize("size, edits, words", [(60, 3, 6), (60, 1, 1000), (200, 3, 40), (40, 2, 3)])
def test_components_of_families(spark, monkeypatch, few, size, edits, words):
    monkeypatch.setattr(ngram_join, "FEW", few)
    texts = family(90, size, size, edits, words) + family(30, size + 1, size, edits, words) + family(20, size, 2 * size, edits, words)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.ngram_join(rows).collect()) == wanted(texts)


def test_pairs_below_the_threshold(spark, monkeypatch):
    """2,000 documents just under the threshold: candidates of the second round stay near the number of documents."""
    made, texts, real = [], family(2000, 4), ngram_join._open_pairs

    def counted(index, labelled):
        pairs = real(index, labelled).cache()
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(ngram_join, "_open_pairs", counted)
    for n in (500, 2000):
        got = ngram_join.ngram_join(spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string"))
        found = {r.doc_id: r.component_id for r in got.collect()}
        assert sorted(found.items()) == components(texts[:n], 3, 90)
    print("pairs of the second round:", made)
    assert made[0] <= 5 * 500 and made[1] <= 5 * 2000  # all pairs would be 124,750 and 1,999,000


def test_parts(spark, monkeypatch):
    """Texts and n-grams dealt out to three parts give the same links."""
    monkeypatch.setattr(ngram_join, "PART", 60, raising=False)
    monkeypatch.setattr(ngram_join, "FEW", 20)
    texts = family(90, 1, 60, 3, 6) + family(30, 2, 60, 3, 6) + family(20, 3, 200, 3, 40)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.ngram_join(rows).collect()) == wanted(texts)
    assert sorted(tuple(r)[:3] for r in ngram_join.ngram_links(rows).collect()) == wanted(texts)


def test_disk(spark, monkeypatch, tmp_path):
    """Where every document shares n-grams, tables and the shuffles of any one write take less than 1.9 times the input."""
    texts = [t for i in range(2000) for t in family(2, i, 300, 3)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    places = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    (tmp_path / "tables").mkdir()
    setting, most = common.setting, []

    def sizes(folder, start=""):
        return {f: f.stat().st_size for f in Path(folder).rglob(f"{start}*") if f.is_file()}

    @contextmanager
    def measured(session, key, value):
        if "shuffle" not in key:
            with setting(session, key, value):
                yield
            return
        before = {f for x in places for f in sizes(x, "shuffle_")}
        yield  # shuffles stay, to be counted
        new = sum(n for x in places for f, n in sizes(x, "shuffle_").items() if f not in before)
        most.append(new + sum(sizes(tmp_path / "tables").values()))

    monkeypatch.setattr(common, "_LOCAL_SCRATCH", [f"file://{tmp_path}/tables"])
    monkeypatch.setattr(common, "setting", measured)
    monkeypatch.setattr(ngram_join, "PART", 1000, raising=False)
    found = ngram_join.ngram_join(spark.read.parquet(str(tmp_path / "docs")), 5, (80, 100)).select("component_id").distinct().count()
    share = max(most) / sum(sizes(tmp_path / "docs").values())
    print("disk, as a share of the input:", share, "components:", found)
    assert share < 1.9  # 2.08 when all steps shuffled everything at once


def test_repeated_ids_with_other_texts(spark):
    rows = [(1, "a b c d e"), (1, "p q r s t"), (2, "a b c d e"), (3, "p q r s t"), (None, "a b c d e"), (4, None), (4, "x")]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(rows) and of[None] is None and of[4] == 4
    assert (of[1], of[2], of[3]) in {(1, 1, 3), (1, 2, 1)}  # the text with the least hash stands for document 1
    text = "".join(f"{i:04d} some words " for i in range(60))
    rows = [(1, text), (1, "other " * 20), (None, text[:500]), (None, "b"), (2, None)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got) == [("1", 120, 0), ("1", len(text), 500), ("2", 0, 0), ("None", 1, 0), ("None", 500, 500)]


def test_clashing_columns(spark):
    schema = "doc_id long, text string, source string, row string, head string, id string, digest string, copies int, more int, a int, b int, label int, tag long"
    rows = spark.createDataFrame([(i, f"t{i % 4} b c d e", "s", "r", "h", "i", "d", 9, 9, 9, 9, 9, 9) for i in range(8)], schema)
    assert ngram_join.keep_one(rows).columns == rows.columns and ngram_join.keep_one(rows).count() == 4
    assert mixing.take_copies(rows).columns == rows.columns and ngram_join.ngram_links(rows).count() == 8 and suffix_dedup.remove_repeats(rows).count() == 8


def test_repeated_rows_of_the_mix(spark):
    rows = spark.createDataFrame([(1, "a b", "s")] * 3 + [(1, "c d", "s"), (2, "e f", "t"), (3, None, None)], "doc_id long, text string, source string")
    mixed, taken = mixing.mix_sources(rows).collect(), mixing.take_copies(rows).collect()
    assert len(mixed) == 6 and all(r.taken <= 2 * r.size for r in mixed)
    assert len(taken) == sum(r.copies for r in mixed) and sum(r.text == "c d" for r in taken) <= 2


def test_certain_documents(spark):
    """One document larger than what is to be sampled of its source: p never exceeds 1, and expected words are the rest."""
    rows = [(i, "w " * n, "s") for i, n in enumerate([5000] + [10] * 100 + [1] * 50)] + [(1000 + i, "w " * 40, "t") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = docs.select("source", F.regexp_count("text", F.lit(mixing.WORD)).cast("long").alias("size"))
    plan = spark.createDataFrame([("s", 5400.0), ("t", 777.0)], "of string, rest double")
    level = {r.of: r.level for r in mixing.inclusion(sizes, plan).collect()}
    for name, rest in (("s", 5400.0), ("t", 777.0)):
        own = np.array([r.size for r in sizes.where(F.col("source") == name).collect()])
        p = np.minimum(level[name] * own, 1)
        assert abs((p * own).sum() - rest) < 1e-6 and (p.max() == 1) == (name == "s")


def brute_finer(before, after, width, to):
    """(bytes left of the old core, right of it) of every string, by the piece of ``to`` places that it belongs to."""
    out = {}
    for l in range(width - 1 - len(after), len(before) + 1):
        out.setdefault(l // to, []).append((before[len(before) - l :], after[: width - 1 - l]))
    return out


def test_finer_pieces():
    rng = np.random.default_rng(0)
    for width, to in ((32, 8), (8, 2)):
        for _ in range(200):
            nb = int(rng.integers(0, width))
            na = int(rng.integers(width - 1 - nb, width))
            before, after = rng.bytes(nb), rng.bytes(na)
            want = brute_finer(before, after, width, to)
            got = suffix_dedup.finer(before, after, width, to)
            assert [g[0] for g in got] == sorted(want)
            for k, low, b, left, right, a in got:
                assert before[low:] == b + left and after.startswith(right + a)
                strings = {(b[len(b) - j :] + left, right + a[: to - 1 - j]) for j in range(to - 1 - len(a), len(b) + 1)}
                assert strings == set(want[k])


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_groups_dealt_by_longer_cores(spark, hot, monkeypatch):
    """A passage whose surroundings differ in many documents, next to plain copies: the same bytes go at every size of group."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(1)
    passage = "".join(chr(97 + i) for i in rng.integers(0, 26, 430))
    texts = [passage[i % 31 : 400 + i % 29] + "".join(chr(65 + c) for c in rng.integers(0, 2, i % 9)) for i in range(60)]
    texts = [" ".join(map(str, rng.integers(0, 99, 20))) + t for t in texts] + texts[:7] + ["z" * 900, "yz" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
    want = {r[0]: r[1:4] for r in con.execute(suffix_dedup.SQL).fetchall()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans)) for r in suffix_dedup.remove_repeats(docs).collect()} == want
