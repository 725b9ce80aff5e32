from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")

from glossaloom.llm import pii  # noqa: E402
from tests.llm.test_minhash import brute as brute_similar  # noqa: E402
from tests.llm.test_pii import brute  # noqa: E402
from tests.llm.test_text_ops import brute_leaks  # noqa: E402


def brute_pipeline(docs, items):
    """Texts by id that should reach packing."""
    kept = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    comp = brute_similar(kept)
    kept = [(i, t) for i, t in dict(kept).items() if comp[i] == i]
    leaked = {i for i, _ in brute_leaks(kept, items)}
    out = {}
    for i, t in kept:
        if i not in leaked:
            text, at = "", 0
            for a, k, b in brute(t):
                if a >= at:
                    text += t[at:a] + f"[{pii.KINDS[k].upper()}]"
                at = max(at, b)
            out[i] = text + t[at:]
    return out


def check(rows, want):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(want)
    for i, text in want.items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_run_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    check(pipeline.run(spark, sf).collect(), brute_pipeline(docs, items))


def test_stages_keep_columns_and_odd_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = [(9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, "123 456", "en", "s", 7), (None, "words without an id here", "en", "s", 3), (None, "words without an id here", "en", "s", 3), (9004, "the same row of words twice", None, None, 5), (9004, "the same row of words twice", None, None, 5)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    docs = docs.select("*", F.lit("x").alias("score"), F.lit(1).alias("lang_pred"), F.lit(2).alias("found"), F.lit("y").alias("spans"), F.lit("z").alias("t"))
    at = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
    ids = [r.doc_id for r in at.collect()]
    assert ids.count(None) == 1 and ids.count(9004) == 1 and not {9001, 9002, 9003} & set(ids)
    assert {r.score for r in at.collect()} == {"x"} and {r.found for r in at.collect()} == {2}


def test_different_texts_of_an_id_are_judged_apart(spark, sf):
    """Nothing is lost by a repeated id, and the order of rows changes nothing."""
    words = lambda a, n: " ".join(f"w{a}x{k}" for k in range(n))
    a, near_a, b, c, d = words(1, 100), words(1, 98), words(2, 40), words(3, 40), words(4, 9)
    rows = [(3, a), (5, near_a), (5, b), (7, b), (7, c), (8, d), (8, d), (None, d), (None, words(5, 9)), (9, a.upper())]
    for order in (rows, rows[::-1], rows[4:] + rows[:4]):
        got = pipeline.near_duplicates(spark, spark.createDataFrame(order, "doc_id long, text string"), sf).collect()
        assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(3, a), (5, b), (7, c), (8, d), (None, words(5, 9))], "doc_id long, text string").collect()))


def test_empty_table(spark, sf, tmp_path):
    at = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        at = stage(spark, at, sf)
    assert at.count() == 0


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)) and "pipeline" in names


def test_language_stage_moves_a_text_once(spark, sf, monkeypatch):
    seen = []
    predict = pipeline.langid.predict_languages
    monkeypatch.setattr(pipeline.langid, "predict_languages", lambda docs, *a: (seen.append(docs.columns), predict(docs, *a))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(2))
    kept = pipeline.language_id(spark, docs, sf)
    assert kept.columns == docs.columns and kept.first().lang_pred == "x" and kept.first().score == 2
    assert len(seen[0]) == len(docs.columns)
