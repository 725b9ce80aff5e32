from __future__ import annotations

import random
from itertools import combinations
from math import comb

import duckdb
import pytest

from glossaloom.llm import coordinates as C


def shingle_set(text, size=2):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(docs, size=2):
    """{row: (doc_id, n, component_id)}: every pair compared."""
    sets = [shingle_set(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        x, y = sets[a], sets[b]
        if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(str((i, len(s), least.get(find(k)) if s else i)) for k, ((i, _), s) in enumerate(zip(docs, sets)))


def found(spark, docs, size=2, ddl="doc_id long, text string"):
    rows = C.near_components(spark.createDataFrame(docs, ddl), words=size).collect()
    return sorted(str((r.id, r.n, r.component_id)) for r in rows)


def edited(rng, words, share):
    return " ".join(rng.choice(words) + str(rng.randrange(90)) if rng.random() < share else w for w in words)


def families():
    """Near copies with edits of their own, texts around one passage, texts from one template, chains, copies and odd texts."""
    rng, docs = random.Random(3), []
    base = [f"b{k}" for k in range(150)]
    docs += [edited(rng, base, rng.choice([0.0, 0.02, 0.05, 0.1, 0.15])) for _ in range(90)]
    dropped = base[:60] + base[90:]
    docs += [edited(rng, dropped, rng.choice([0.0, 0.03, 0.08])) for _ in range(25)]
    passage = " ".join(f"p{k}" for k in range(64))
    docs += [passage + " " + " ".join(f"q{n}x{k}" for k in range(rng.randint(5, 40))) for n in range(80)]
    docs += [" ".join(f"s{k}v{rng.randrange(3)} t{k} u{k} w{k}" for k in range(20)) for _ in range(80)]
    docs += [" ".join(f"c{k}" for k in range(12 * i, 12 * i + 150)) for i in range(30)]
    docs += ["", None, " \t\n", "one", "ONE", "two words", "Two\x0bWords", "two words more", "ärger Ärger", "ÄRGER ärger", "a a a a a", "a a"]
    docs += docs[:5]
    rng.shuffle(docs)
    return [(None if k % 97 == 5 else k // 2 if k % 50 == 1 else k, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("short", [C.SHORT, 2])
def test_families_equal_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(C, "SHORT", short)
    docs = families()
    assert found(spark, docs) == brute(docs)


def test_five_words(spark):
    docs = families()
    assert found(spark, docs, 5) == brute(docs, 5)


def test_whole_table_equals_brute_force_and_sql(spark, sf):
    frame = C.op12_minhash_coordinates(spark, sf)
    rows = frame.collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in rows) == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and not all(r.kept for r in rows)
    duckdb.sql(f"create or replace view documents as select * from read_parquet('{sf}/documents.parquet')")
    assert sorted(duckdb.sql(C.ORACLES["op12_minhash_coordinates"]).select(*frame.columns).fetchall()) == sorted(tuple(r) for r in rows)


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    """Edits of their own: a tenth of all pairs at most are candidates."""
    counted = []
    confirmed = C._confirmed
    monkeypatch.setattr(C, "_confirmed", lambda pairs, sets, percent: (counted.append(pairs.count()), confirmed(pairs, sets, percent))[1])
    rng = random.Random(4)
    base = [f"b{k}" for k in range(150)]
    docs = [(k, edited(rng, base, rng.choice([0.02, 0.05, 0.08, 0.1, 0.12]))) for k in range(500)]
    assert found(spark, docs) == brute(docs)
    assert sum(counted) < 500 * 499 / 2 / 10


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    docs = [(1, "a b c d", 5, 7), (2, "a b c d", 5, 7), (3, "e f", 5, 7)]
    assert found(spark, docs, ddl="doc_id long, text string, sid int, n int") == brute([d[:2] for d in docs])


def test_threshold():
    t = C.least_matches(80)
    miss = lambda t, j: sum(comb(128, k) * j**k * (1 - j) ** (128 - k) for k in range(t))
    assert miss(t, 0.8) <= 1e-7 < miss(t + 1, 0.8)
    assert 1 - miss(t, 0.5) < 0.02


def test_pairs_of_coordinates_lose_nothing():
    rng = random.Random(5)
    least = C.least_matches(80)
    width, values = C.least_values(least)
    assert (width, values) == (2, least - 64) and C.least_values(60) == (1, 60)
    for _ in range(300):
        same = set(rng.sample(range(128), least))
        assert sum(k in same and k + 1 in same for k in range(0, 128, 2)) >= values


def test_one_centre_for_a_component(spark):
    """Lists whose central sets are in one component place a set once, at the most central of these."""
    long = spark.createDataFrame([(t, s, 9, s) for t in (1, 2, 3) for s in (20, 21)], "token long, sid long, n long, part long")
    roots = spark.createDataFrame([(1, (5, 10)), (2, (7, 11)), (3, (6, 12))], "token long, r struct<weight:long,sid:long>")
    parts = spark.createDataFrame([(10, 10), (11, 10), (12, 12)], "sid long, part long")
    rows = C._placed(long, roots, parts).collect()
    assert sorted((r.r, r.sid, r.n, r.part) for r in rows) == [(11, 20, 9, 20), (11, 21, 9, 21), (12, 20, 9, 20), (12, 21, 9, 21)]


def test_differences_of_a_large_group_make_few_rows(spark, monkeypatch):
    """Sets far from their centre bring n / 4 of their differences at most, and a bounded number of sets chooses the centre."""
    monkeypatch.setattr(C, "VOTERS", 8)
    rng = random.Random(6)
    hashes = lambda k, n: [rng.getrandbits(62) * 2 + k for _ in range(n)]
    base, usual = hashes(0, 100), hashes(0, 20)
    rows = [(1, base)] + [(k, [*rng.sample(base, 60), *usual, *hashes(1, 20)]) for k in range(2, 202)]
    rows += [(k + 1000, h[:95] + hashes(0, 5)) for k, h in rows[1:40]]
    sets = spark.createDataFrame(rows, "sid long, hashes array<long>")
    placed = spark.createDataFrame([(1, k, 100, k) for k, _ in rows[1:]], "r long, sid long, n long, part long")
    own = C._centred(C._differences(placed, sets)).selectExpr("*", "size(features) as k", "180 * size(features) - 20 * n as e")
    own = own.join(own.groupBy("r").agg(C.F.min(C.F.struct("e", "sid", "part")).alias("s")), "r")
    index, asked = C._beginnings(own, 80)
    assert own.agg(C.F.avg("k")).first()[0] > 50
    assert index.count() <= 13 * (len(rows) - 1) and asked.count() <= 27 * (len(rows) - 1)
    assert {tuple(r) for r in C._residual(placed, sets, 80).collect()} == {(k, k + 1000) for k in range(2, 41)}
