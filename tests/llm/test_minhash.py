from __future__ import annotations

from itertools import combinations

import corpus_pipeline as pipeline
from glossaloom.llm import minhash


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs):
    """Smallest id of each component under a Jaccard similarity of at least 0.8, every pair compared."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: find(i) for i in sets}


def words(a, n):
    return " ".join(f"w{a}x{k}" for k in range(n))


def test_components_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = {r.id: r.component_id for r in minhash.jaccard_components(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    want = brute(docs)
    assert found == want
    assert want[177] == 1 and want[145] == 6  # 11 and 7 bits apart as fingerprints


def test_stage_drops_near_copies_at_the_threshold(spark, sf):
    base, tail = words(1, 100), words(1, 124)
    docs = [(1, base), (2, words(1, 99).upper() + "  zz"), (3, words(2, 20)), (4, words(2, 22)), (5, words(3, 20)), (6, words(3, 26)), (7, tail), (8, words(4, 3)), (9, words(4, 4)), (10, words(4, 3).upper())]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i for i, c in brute(docs).items() if i == c}
    assert {r.doc_id for r in pipeline.near_duplicates(spark, frame, sf).collect()} == want == {1, 3, 5, 6, 8, 9}


def test_members_unlike_the_root_are_compared_with_each_other(spark):
    """A chain: each is similar to the next only, so one comparison per posting isn't enough."""
    docs = [(i, " ".join(f"w{k}" for k in range(12 * i, 12 * i + 150))) for i in range(40)]
    found = {r.id: r.component_id for r in minhash.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == brute(docs) and set(found.values()) == {0}
