"""The pipeline's stages against brute force on a small table."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.fixtures import documents, frame
from tests.llm.test_near_dedup import brute
from tidemark.llm.common import written
from tidemark.llm.tokens import packed, tokenizer


def test_stages(spark):
    rows = documents(140, 5)
    docs = frame(spark, rows)
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "near_dedup", "secret_scan", "mixing", "packing"]
    one = written(P.language(spark, docs, ""), "t1")
    ids = {r.doc_id for r in one.collect()}
    assert ids == {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    two = written(P.near_dedup(spark, one, ""), "t2")
    assert sorted(r.doc_id for r in two.collect()) == [i for i, _, _, kept in brute([(i, t) for i, t, *_ in rows if i in ids]) if kept]
    three = written(P.secrets(spark, two, ""), "t3")
    assert three.columns == docs.columns and three.count() == two.count()
    secret = next(r.text for r in three.collect() if r.doc_id == 77)
    assert secret == 'x [SECRET]" y [SECRET] z [SECRET] secret: tiny [SECRET]'
    assert next(r.text for r in three.collect() if r.doc_id == 78).startswith("bare [SECRET] here")
    assert all(r.n_chars == len(r.text) for r in three.collect())
    four = written(P.mixing(spark, three, ""), "t4")
    assert four.columns == docs.columns
    five = P.packing(spark, four, "").collect()
    t = tokenizer("word_bpe_49k.json")
    want = sorted((r.doc_id, packed([*t.encode(r.text, add_special_tokens=False).ids, 1])) for r in four.collect())
    found = sorted((r.doc_id, r.start, bytes(r.ids)) for r in five)
    assert sum(len(x) for _, x in want) == sum(len(x) for _, _, x in found)
    short = [(i, x) for i, x in want if len(x) <= 4 * 2048]
    assert short == [(i, x) for i, s, x in found if len(x) < 4 * 2048 and s == 0 and (i, x) in short]


def test_run_on_a_folder(spark, tmp_path):
    rows = documents(100, random.randrange(3))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path))
    assert got.count() > 0 and "sequence_id" in got.columns


def test_texts_stay_where_no_language_was_learnt(spark):
    rows = [(1, "some words " * 30, None, "s", 0), (2, "Ère", None, "s", 0), (3, "123 !", None, "s", 0), (4, None, None, "s", 0), (5, "", None, "s", 0)]
    assert sorted(r.doc_id for r in P.language(spark, frame(spark, rows), "").collect()) == [1, 2]


def test_clashing_columns_stay_as_they_are(spark):
    rows = [(i, "the other words of a text " * 3 + str(i), "en", "s", 0) for i in range(8)]
    docs = frame(spark, rows, extra=True).withColumn("score", F.lit(-5.0)).withColumn("lang_pred", F.lit("mine"))
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        assert {(r.score, r.lang_pred, r.component, r.text_md5) for r in got.collect()} == {(-5.0, "mine", "clash", "clash")}


def test_different_texts_under_one_id_stay(spark):
    words = lambda k: " ".join(f"{k}word{i}" for i in range(30))
    rows = [(5, words("a"), "en", "s", 0), (5, words("b"), "en", "s", 0), (5, words("c"), "en", "s", 0), (3, words("a"), "en", "s", 0), (5, words("c"), "en", "s", 0), (None, words("d"), "en", "s", 0), (None, words("d"), "en", "s", 0), (None, words("b"), "en", "s", 0), (9, None, "en", "s", 0), (9, "", "en", "s", 0)]
    got = P.near_dedup(spark, frame(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, (r.text or "-")[:1]) for r in got) == [(0, "d"), (3, "a"), (5, "b"), (5, "c"), (9, "-"), (9, "-")]


def test_empty_table_and_rows_of_nulls(spark):
    for rows in ([], [(None, None, None, None, None)] * 3):
        docs = frame(spark, rows)
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns
            assert stage(spark, docs, "").count() <= len(rows)
        assert P.packing(spark, docs, "").count() <= len(rows)
