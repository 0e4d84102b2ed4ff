"""Corpus queries over the driver's small tables: SQL where there is some, held-out accuracy, and the pipeline."""

import hashlib
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from deskflow.llm import bpe, common, exact_dedup, language_id, mixing, ngram_join, queries, quality

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(queries.SQL[name]).df())


def test_held_out(spark):
    docs = pd.read_parquet(f"{BIG}/documents.parquet", columns=["doc_id", "lang"])
    got = language_id.op4_language_id(spark, BIG).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and (got.lang == got.lang_pred)[got.held_out].mean() > 0.97
    labels = pd.read_parquet(f"{BIG}/labels.parquet")
    got = quality.op2_quality_classifier(spark, BIG).toPandas().merge(labels, on="doc_id")
    held = got[got.held_out]
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert np.mean(good[:, None] > bad) > 0.95 and (held.predicted == held.quality).mean() > 0.9


def test_pipeline(spark):
    """run() against the stages' rules applied by hand, mixing excepted, whose own SQL gives the copies."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = common.materialise(stage(spark, docs, SF), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = docs.toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    best = {r[0] for r in con.execute(f"SELECT doc_id FROM ({exact_dedup.SQL}) WHERE kept").fetchall()}
    con.execute(f"CREATE OR REPLACE TABLE once AS SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({exact_dedup.SQL}) WHERE kept)")
    five = ngram_join.SQL.replace("FROM documents", "FROM once").replace("len(words) < 3", "len(words) < 5").replace("len(words) - 1", "len(words) - 3").replace("words[i + 2]", "words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4]").replace(">= 90 *", ">= 80 *")
    heads = {r[0] for r in con.execute(f"SELECT doc_id FROM ({five}) WHERE doc_id = component_id").fetchall()}
    assert heads <= best and set(kept.doc_id) == heads
    con.execute("DROP VIEW documents")
    con.register("documents", kept)
    copies = dict(con.execute(f"SELECT doc_id, copies FROM ({mixing.SQL})").fetchall())
    lib, want = Tokenizer.from_file(bpe.word_bpe_path()), []
    for r in kept.itertuples():
        ids = lib.encode(r.text, add_special_tokens=False).ids
        want += [(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] * copies[r.doc_id]
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
