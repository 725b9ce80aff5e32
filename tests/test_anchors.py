"""Anchors: keys of all lengths are found, and texts bring few places."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from glossaloom.operators import anchors as A
from glossaloom.operators import memory as M


def test_equal_to_all_pairs(spark):
    r = random.Random(5)
    syllables = ["ab", "a", "ña", "𝒳y", "the ", " ", "xx"]
    texts = ["".join(r.choice(syllables) for _ in range(r.choice([3, 12, 40, 90]))) for _ in range(60)] + ["a" * n for n in (1, 7, 8, 31, 64, 200)]
    keys = set()
    for t in texts:
        for m in (1, 2, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 100):
            at = r.randrange(max(1, len(t) - m + 1))
            keys.add(t[at : at + m])
    rows, asked = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "text string"), spark.createDataFrame([(k,) for k in [*keys, "", None]], "key string")
    got = [tuple(x) for x in M.contained_keys(rows, asked).collect()]
    assert sorted(got) == sorted((t, k) for t in set(texts) for k in keys if k and k in t and len(t) > len(k))


def test_long_texts_are_cut_without_loss(spark):
    r = random.Random(6)
    text = "".join(r.choice("abcdefgh ") for _ in range(3 * A._PIECE))
    keys = [text[k * A._PIECE - 40 : k * A._PIECE + m] for k in (1, 2) for m in (1, 20, 90)]
    got = M.contained_keys(spark.createDataFrame([(text,)], "text string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    assert {x.key for x in got.collect()} == set(keys)


def test_texts_bring_few_places(spark):
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    lines = spark.createDataFrame([(word(400),) for _ in range(200)], "text string")
    filed = A.filed(lines.select(F.col("text").alias("key"))).cache()
    assert A.brought(lines, filed).count() < 2 * 200  # each meets itself; all grams were 78,600


def _near_copies(r: random.Random, size: int, count: int) -> list[str]:
    """Lines that begin alike and differ in one word each."""
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(size)]
    return [" ".join([*words[: size // 3 + k], f"changed{k}", *words[size // 3 + k + 1 :]]) for k in range(count)]


def _all_pairs(texts: list[str], keys: list[str]) -> list[tuple[str, str]]:
    return sorted((t, k) for t in texts for k in keys if k in t and len(t) > len(k))


def _candidates(spark) -> int:
    newest = max(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("contained_candidates_*"), key=lambda p: p.stat().st_mtime_ns)
    return spark.read.parquet(str(newest)).count()


def test_pairs_of_short_keys_and_near_copies_do_not_move(spark):
    r = random.Random(8)
    lines = [*_near_copies(r, 60, 40), "ab", "abc", "a", "bc d", "gh"]
    rows = spark.createDataFrame([(t,) for t in lines], "text string")
    got = sorted(tuple(x) for x in M.contained_keys(rows, rows.select(F.col("text").alias("key"))).collect())
    assert got == _all_pairs(lines, lines) and len(got) >= 40
    assert _candidates(spark) < 20  # each near copy met all others that are longer, and each short key most of them


def test_copies_with_changes_anywhere(spark):
    r = random.Random(9)
    texts = _near_copies(r, 12, 5) + _near_copies(r, 40, 9) + _near_copies(r, 400, 9)
    keys = {t[a : a + m] for t in texts for m in (9, 15, 16, 31, 32, 63, 64, 90, 300, 1087, 1088, 1100, 2000) for a in (0, 7, r.randrange(len(t)))}
    keys |= {k[:-1] + "?" for k in keys} | {"?" + k[1:] for k in keys}
    twelve = [" ".join(["the same words all over, " * 3] * n) for n in (A.APART // 3, A.APART + 4)]
    texts, keys = [*texts, *twelve], [*keys, twelve[0], "words all over, the same words"]
    got = M.contained_keys(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    assert sorted(tuple(x) for x in got.collect()) == _all_pairs(texts, keys)


def test_short_keys_beyond_the_block(spark, monkeypatch):
    monkeypatch.setattr(A, "SHORT", 5)
    r = random.Random(10)
    text = "".join(r.choice("abcdefgh ") for _ in range(2 * A._PIECE + 100))
    texts = [text, "ab", "xéy", "𝒳ab", "none", ""]
    keys = ["a", "é", "ab", "𝒳a", text[A._PIECE - 3 : A._PIECE + 4], text[2 * A._PIECE - 1 : 2 * A._PIECE + 1], "zz", text[:3], text[-7:], "xéy"]
    asked = spark.createDataFrame([(k,) for k in keys], "key string")
    assert A.short_keys(asked)[0] == 1
    got = M.contained_keys(spark.createDataFrame([(t,) for t in texts], "text string"), asked)
    assert sorted(tuple(x) for x in got.collect()) == _all_pairs(texts, sorted(set(keys)))
    monkeypatch.undo()
    assert A.short_keys(asked)[0] == A.GRAM - 1
    assert sorted(tuple(x) for x in M.contained_keys(spark.createDataFrame([(t,) for t in texts], "text string"), asked).collect()) == sorted(tuple(x) for x in got.collect())
