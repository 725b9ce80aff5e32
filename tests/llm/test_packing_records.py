from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glossaloom.llm import packing, records
from glossaloom.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, wörld.", None, "", "a " * 9000, "don't stop. Ñandú's <|endoftext|>", "same", "same", "x" * 3000, "\t \n"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=list("abZÉßñ .,'\n\t ΣİσA1-<|>éﬁ\x1c\x85̂中") , max_size=40), max_size=4))
def test_encoder_equals_library(texts):
    whole = Tokenizer.from_file(PATH)
    got = encoder(PATH).encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_encoder_on_other_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  world.", "", "é\n x"]
    assert [np.frombuffer(g, encoder(path).dtype).tolist() for g in encoder(path).encode(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9000), max_size=60))
def test_pack_fills_every_sequence(lengths):
    pieces = packing.pack(lengths)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc, start, n, seq, offset in pieces:
        assert n > 0
        by_doc[doc].append((start, n))
        by_seq[seq].append((offset, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(by_doc[doc]):
            assert start == at
            at += size
        assert at == n
    for own in by_seq.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 4096 and at & (at - 1) == 0


def test_pack_balances_cost():
    rng = random.Random(1)
    lengths = [rng.randint(10, 1500) for _ in range(900)]
    cost = defaultdict(float)
    naive = defaultdict(float)
    for _, _, n, seq, _ in packing.pack(lengths):
        cost[seq] += packing.piece_cost(n)
    at = 0
    for n in lengths:
        naive[at // 4096] += packing.piece_cost(n)
        at += n
    full = sorted(cost.values())[-(sum(lengths) // 4096) :]
    assert max(full) - min(full) < (max(naive.values()) - sorted(naive.values())[1])


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, "x", 7) for k, t in enumerate(texts)], "doc_id long, text string, start string, length int").repartition(3)


def test_packed_pieces(spark, tokenizer):
    rows = packing.pack_documents(frame(spark), PATH, end_id=2, window_tokens=5000).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for k, text in enumerate(TEXTS):
        want = ids_of(tokenizer, text, 2)
        own = sorted(docs[k], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == np.array(want, "<u4").tobytes()
        assert all(r.doc_tokens == len(want) for r in own)
    for own in seqs.values():
        assert sum(r.length for r in own) <= 4096


def test_packing_edges(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).count() == 0
    rows = packing.pack_documents(spark.createDataFrame([(None, "a"), (3, "b"), (3, "b")], "doc_id long, text string"), PATH, 2).collect()
    assert sorted(str(r.doc_id) for r in rows if r.start == 0) == ["3", "3", "None"]


@pytest.mark.parametrize("seed", [None, 5])
def test_records_round_trip(spark, tokenizer, tmp_path, seed):
    path = f"file://{tmp_path}/rec"
    records.write_records(frame(spark), path, PATH, end_id=1, partitions=3)
    rows = {r.doc_id: r for r in records.read_records(spark, path, seed).collect()}
    at = 0
    for k, text in enumerate(TEXTS):
        want = ids_of(tokenizer, text, 1)
        assert rows[k].start == at and rows[k].n_tokens == len(want) and zlib.crc32(rows[k].ids) == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_records_edges(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    records.write_records(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 1)
    assert records.read_records(spark, path).count() == 0
    path = f"file://{tmp_path}/odd"
    records.write_records(spark.createDataFrame([(None, "a"), (2, None), (2, "b"), (2, "b")], "doc_id long, text string"), path, PATH, 1)
    rows = records.read_records(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 2, 2, 2]


@pytest.mark.parametrize("seed", [None, 5])
def test_records_of_one_id_fill_several_files(spark, tokenizer, tmp_path, seed):
    texts = [f"row {k} of one id" for k in range(300)]
    path = f"file://{tmp_path}/hot"
    manifest = records.write_records(spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string"), path, PATH, 1, partitions=4, file_bytes=700)
    files = manifest.collect()
    assert len({r.part for r in files}) > 1 and len({(r.part, r.place) for r in files}) == len(files) > 4
    rows = sorted(records.read_records(spark, path, seed).collect(), key=lambda r: r.start)
    assert sorted(r.ids for r in rows) == sorted(np.array(ids_of(tokenizer, t, 1), "<u4").tobytes() for t in texts)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(len(rows))]


def test_damage_is_seen():
    good = records.frame(b"payload")
    assert bytes(records.unframe(memoryview(good))) == b"payload"
    for k in (0, 9, 14, len(good) - 1):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(bytes(bad)))


def test_queries(spark, sf, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at = 0
    read = {r.doc_id: r for r in records.op5_token_records(spark, sf).collect()}
    for k in sorted(docs):
        want = np.array(ids_of(tokenizer, docs[k], 1), "<u4")
        assert (read[k].start, read[k].n_tokens, read[k].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    for r in packing.op1_cost_balanced_packing(spark, sf).collect():
        want = np.array(ids_of(tokenizer, docs[r.doc_id], 2), "<u4")
        assert r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
