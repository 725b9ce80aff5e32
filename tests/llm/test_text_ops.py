from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glossaloom.llm import decontam, graph, langid, simhash, spans


def docs_of(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# Language identification.


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = docs_of(spark, sf)
    rows = langid.op3_word_backoff_langid(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and held
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_backoff_and_und(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog are here with the house", "en"), ("der hund und die katze sind nicht im haus", "de")] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_on(docs)
    ask = [(1, "the dog"), (2, "hundhaus"), (3, None), (4, "123 !?"), (5, ""), (6, "²½"), (7, "THE CAT"), (8, "the " * 50_000)]
    frame = spark.createDataFrame([(k, t, "?", 1) for k, t in ask], "doc_id long, text string, score string, lang_pred int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_languages(frame, model).collect()}
    assert got[1][0] == got[7][0] == got[8][0] == "en" and got[2][0] == "de"
    assert all(got[k] == ("und", 0.0) for k in (3, 4, 5, 6))


def brute_language(model_rows, texts):
    """(language, score) of each text by the rule, from (text, lang) rows, with plain dictionaries."""
    grams = lambda w, n: [f" {w} "[k : k + n] for k in range(len(w) + 3 - n)]
    split = lambda t: [w for w in re.split(r"[\W\d_]+", t.lower()) if w]
    counts = defaultdict(Counter)
    for t, lang in model_rows:
        counts[lang, 0].update(split(t))
    for lang in {lang for _, lang in model_rows}:
        for w, k in counts[lang, 0].items():
            for n in range(1, 6):
                for g in grams(w, n):
                    counts[lang, n][g] += k
    langs = sorted({lang for _, lang in model_rows})
    total = {k: sum(c.values()) for k, c in counts.items()}
    share = {k: {t: n / total[k] for t, n in c.items()} for k, c in counts.items()}
    for text in texts:
        words = split(text or "")
        sums = np.zeros(len(langs))
        for w in words:
            for n in range(6, 0, -1):
                tokens = [w] if n == 6 else grams(w, n)
                known = [[-np.log10(share[x, n % 6][t]) if t in share[x, n % 6] else 7.0 for x in langs] for t in tokens if any(t in share[x, n % 6] for x in langs)]
                if known:
                    sums += np.mean(known, axis=0)
                    break
            else:
                sums += 7.0
        mean = sums / max(1, len(words))
        odds = np.exp((mean.min() - mean) * np.log(10) * min(len(words), 25))
        yield (langs[int(mean.argmin())], float(1 / odds.sum())) if words else ("und", 0.0)


def test_predictions_equal_brute_force(spark, sf):
    """All languages, words and n-grams; every document."""
    docs = docs_of(spark, sf)
    known = [(r.text, r.lang) for r in docs.values() if r.text and r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    rows = {r.doc_id: r for r in langid.op3_word_backoff_langid(spark, sf).collect()}
    for (d, r), (lang, score) in zip(docs.items(), brute_language(known, [r.text for r in docs.values()])):
        assert rows[d].lang_pred == lang and abs(rows[d].score - score) < 1e-4


def test_many_labels_and_marks(spark):
    """No label is left out, however rare; combining marks belong to their word."""
    rows = [(k, f"w{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100]} same", f"l{k}") for k in range(300)]
    rows += [(1000 + k, "\u0928\u092e\u0938\u094d\u0924\u0947 \u0926\u0941\u0928\u093f\u092f\u093e", "hi") for k in range(3)]
    model = langid.train(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert len(model["langs"]) == 301
    own = langid.Scorer(model)
    assert all(own.predict(t.split()[0])[0] == lang for _, t, lang in rows[:300:17])
    assert langid.words_of("\u0928\u092e\u0938\u094d\u0924\u0947 cafe\u0301 x1") == ["\u0928\u092e\u0938\u094d\u0924\u0947", "cafe\u0301", "x"]
    assert own.predict("\u0928\u092e\u0938\u094d\u0924\u0947")[0] == "hi"


def test_model_is_linear_in_labels(spark):
    """300 labels: no more than 24 bytes for each token of a label; every token is there, however rare."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k, " ".join("".join(rng.choices(letters, k=7)) for _ in range(40)), f"l{k % 300}") for k in range(900)]
    model = langid.train(spark.createDataFrame(rows, "id long, text string, lang string"))
    words = {(lang, w) for _, t, lang in rows for w in t.split()}
    tokens = {(lang, n, f" {w} "[k : k + n]) for lang, w in words for n in range(1, 6) for k in range(len(w) + 3 - n)}
    assert len(model["langs"]) == 300 and len(model["labels"]) == len(words) + len(tokens)
    assert langid.model_bytes(model) <= 24 * len(model["labels"]) + 48
    half = langid.train(spark.createDataFrame([r for r in rows if int(r[2][1:]) < 150], "id long, text string, lang string"))
    assert langid.model_bytes(model) < 2.2 * langid.model_bytes(half)


def test_sample_is_bounded_by_characters(spark):
    """About 40 of 400 rows of 5,000 characters make 200,000; each has a word of its own."""
    letters = "abcdefghij"
    rows = [(k, f"own{letters[k // 100]}{letters[k // 10 % 10]}{letters[k % 10]} " + "word " * 1000, "en") for k in range(400)]
    model = langid.train(spark.createDataFrame(rows, "id long, text string, lang string"), chars_per_lang=200_000)
    assert 15 < len(model["hashes"][0]) - 1 < 80
    assert len(langid.train(spark.createDataFrame(rows, "id long, text string, lang string"))["hashes"][0]) == 401


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train_on(empty)
    assert langid.predict_languages(empty, model).count() == 0
    one = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert langid.predict_languages(one, langid.train_on(one)).first().lang_pred == "und"


def test_scorer_without_room_gives_the_same(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("one two three", "en"), ("eins zwei drei", "de")] * 40)], "doc_id long, text string, lang string")
    model = langid.train_on(docs)
    wide, narrow = langid.Scorer(model), langid.Scorer(model)
    narrow.rows.room = 1
    for text in ("one zwei", "tworeihe eins", "two two three unknown"):
        assert wide.predict(text)[0] == narrow.predict(text)[0] and abs(wide.predict(text)[1] - narrow.predict(text)[1]) < 1e-6
    small = langid.Scorer(model)
    small.rows.room = 4  # the table begins anew for most texts, or has no room for all their words
    for text in ("one zwei", "tworeihe eins", "two two three unknown", "zwei eins drei one two three", "x" * 50):
        (lang, score), wanted = small.predict_all([text])[0], wide.predict(text)
        assert lang == wanted[0] and abs(score - wanted[1]) < 1e-6


# SimHash.


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=2):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    fps = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits).tolist():
            parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for k in range(len(ids)):
        groups[find(k)].append(ids[k])
    return {i: min(g) for g in groups.values() for i in g}


def test_simhash_query(spark, sf):
    truth = docs_of(spark, sf)
    rows = simhash.op10_simhash(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(int(r.fingerprint, 16) == slow_fingerprint(truth[r.doc_id].text) for r in rows)
    want = brute_components([r.doc_id for r in rows], [int(r.fingerprint, 16) for r in rows])
    assert all(r.component_id == want[r.doc_id] for r in rows)


def test_fingerprint_edges():
    for text in (None, "", " \n\t", "one", "one two", "One TWO three Four É", "a b c " * 30_000, "a\xa0b c\x85d e"):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("seed", range(3))
def test_links_connect_exactly(spark, seed):
    """Dense neighbourhoods: random walks of one or two bits, and far fingerprints."""
    rng = random.Random(seed)
    fps = {0}
    at = rng.getrandbits(64)
    for _ in range(500):
        for _ in range(rng.choice((1, 2, 2, 3))):
            at ^= 1 << rng.randrange(64)
        fps.add(at)
        if rng.random() < 0.02:
            at = rng.getrandbits(64)
    fps |= {at ^ (a | a << 8) for a in range(256)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in graph.connected_components(edges).collect()}
    want = brute_components(signed, fps)
    assert {x: roots.get(x, x) for x in signed} == want


def test_large_posting_equals_small():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 16, 700).astype(np.uint64))
    big = simhash.link_posting(fps, (0, 1), 2)
    want = brute_components(list(range(len(fps))), fps)
    assert [want[k] for k in range(len(fps))] == big.tolist()


def test_simhash_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (2, None), (9, ""), (7, "x y z w v u")], "doc_id long, text string")
    got = sorted((str(r.id), r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == [("2", 2), ("5", 5), ("5", 5), ("7", 7), ("9", 2), ("None", 5)]
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


# Benchmark decontamination.


def brute_leaks(docs, items):
    """Every window of every document against every item, with the same passages and scores."""
    words = {i: decontam.WORD.findall(t.lower()) for i, t in items}
    df = Counter(w for ws in words.values() for w in set(ws))
    mean = sum(map(len, words.values())) / len(words)
    found = set()
    for d, text in docs:
        own = decontam.WORD.findall((text or "").lower())
        for i, ws in words.items():
            if not ws:
                continue
            half = 64
            while half < len(ws):
                half *= 2
            impact = {}
            for w, tf in Counter(ws).items():
                idf = np.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5))
                impact[w] = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            parts = decontam.question_answer(dict(items)[i])
            for a in range(0, max(1, len(own)), half):
                if sum(impact.get(w, 0) for w in set(own[a : a + 2 * half])) < 0.7 * sum(impact.values()) * (1 - 1e-9):
                    continue
                area = own[max(0, a - half) : a + 3 * half]
                ok = True
                for part in parts:
                    s = decontam.shingles(part)
                    n = min(5, len(part))
                    there = {tuple(area[k : k + n]) for k in range(len(area) - n + 1)}
                    ok &= not s or sum(x in there for x in s) / len(s) >= 0.8
                if ok:
                    found.add((d, i))
    return found


def test_leaks_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in docs_of(spark, sf).values()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in decontam.op6_benchmark_decontamination(spark, sf).collect()}
    assert got == brute_leaks(docs, items)
    assert got >= {(d, i) for d, t in docs for i, b in items if b in t}


def test_blocks_of_items_change_nothing(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one, many = decontam.find_leaks(docs, items), decontam.find_leaks(docs, items, block_chars=1500)
    assert {tuple(r)[:2] for r in one.collect()} == {tuple(r)[:2] for r in many.collect()}
    leaked = {r.doc_id for r in one.collect()}
    assert {r.doc_id for r in decontam.without_leaks(docs, items, block_chars=1500).collect()} == {r.doc_id for r in docs.collect()} - leaked


def test_decontam_edges(spark):
    question = "What is the capital of the large island in the north? It is the town of Reykjavik by the sea."
    items = spark.createDataFrame([(1, question), (2, None), (3, ""), (4, "short one"), (5, question)], "item_id long, text string")
    filler = "lorem ipsum dolor " * 80_000
    docs = spark.createDataFrame([(1, question.upper()), (1, question), (2, None), (3, ""), (4, "clean text only"), (5, filler + question + filler), (None, question)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in decontam.find_leaks(docs, items).collect())
    assert got == sorted([("1", 1), ("1", 1), ("1", 5), ("1", 5), ("5", 1), ("5", 5), ("None", 1), ("None", 5)])
    assert decontam.question_answer(question)[1][:3] == ["it", "is", "the"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs, none).count() == 0 and decontam.without_leaks(docs, none).count() == 7
    assert decontam.find_leaks(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0


def test_half_a_leak_is_none(spark):
    item = "who wrote the famous book about the white whale and the sea? a man named herman melville wrote it in the year of 1851 in america"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.split("?")[0]), (2, item)], "doc_id long, text string")
    assert [r.doc_id for r in decontam.find_leaks(docs, items).collect()] == [2]


# Sentence spans.


def brute_spans(docs, least=20, sentences=2):
    """What is left of the text of each different (id, text), by a plain reading of the rule."""
    where = defaultdict(list)
    docs = list(dict.fromkeys(docs))
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64((t or "").encode(), seed=42).intdigest())
    for d, text in docs:
        key = (d is None, d or 0, signed(text))
        b = spans.sentence_bounds(text or "")
        sent = [" ".join((text or "")[x:y].lower().split()) for x, y in zip(b, b[1:])]
        n = [len(s.split()) for s in sent]
        runs = set()
        for i in range(len(sent)):
            for j in range(i + sentences - 1, len(sent)):
                if sum(n[i : j + 1]) >= least:
                    runs.add((i, j))
                    break
            for h in range(i - sentences + 1, -1, -1):
                if sum(n[h : i + 1]) >= least:
                    runs.add((h, i))
                    break
        for i, j in runs:
            where["\n".join(sent[i : j + 1])].append((key, i, j, (d, text)))
    gone = defaultdict(set)
    for places in where.values():
        first = min(p[0] for p in places)
        begin = {p[0]: min(q[1] for q in places if q[0] == p[0]) for p in places}
        for key, i, j, doc in places:
            if key != first or i != begin[key]:
                gone[doc] |= set(range(i, j + 1))
    out = {}
    for d, text in docs:
        b = spans.sentence_bounds(text or "")
        out[d, text] = "".join(text[b[k] : b[k + 1]] for k in range(len(b) - 1) if k not in gone[d, text]) if text else text
    return out


def test_spans_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in docs_of(spark, sf).values()]
    want = brute_spans(docs)
    got = {r.doc_id: r.text for r in spans.op8_sentence_spans(spark, sf).collect()}
    assert got == {d: want[d, t] for d, t in docs if want[d, t] != t}
    everything = spans.remove_repeated_spans(spark.read.parquet(f"{sf}/documents.parquet"), changed_only=False)
    assert {r.doc_id: r.text for r in everything.collect()} == {d: t for (d, _), t in want.items()}


def test_spans_of_repeated_and_null_ids(spark):
    """Rows of one id, or of none, with different texts are documents of their own; identical rows are one."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    say = lambda: " ".join(rng.sample(words, rng.randint(6, 16))).capitalize() + ". "
    shared = ["".join(say() for _ in range(4)) for _ in range(5)]
    rows = []
    for k in range(60):
        parts = [say() for _ in range(rng.randint(0, 6))]
        parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        rows.append((rng.choice((None, None, 3, 3, 7, k)), "".join(parts)))
    rows += rows[:9] + [(3, ""), (None, None), (7, "".join(say() for _ in range(20_000))), (8, "\u0130" + shared[0].upper())]
    want = brute_spans(rows)
    got = spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), changed_only=False).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, want[d, t]) for d, t in rows)
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert spans.remove_repeated_spans(nulls, changed_only=False).count() == 3


def test_planted_passage(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    say = lambda n: " ".join(rng.sample(words, n)).capitalize() + ". "
    passage = "".join(say(n) for n in (9, 14, 8, 12, 15))
    rows = [(k, "".join(say(rng.randint(4, 15)) for _ in range(8)) + (passage if k % 3 == 0 else "") + "".join(say(rng.randint(4, 15)) for _ in range(8))) for k in range(30)]
    got = {r.doc_id: r for r in spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {k for k in range(30) if k % 3 == 0 and k}
    assert all(g.text == dict(rows)[k].replace(passage, "") and g.first_doc_ids == [0] for k, g in got.items())


def test_span_edges(spark):
    line = " ".join(f"word{k}" for k in range(12)) + ". " + " ".join(f"word{k}" for k in range(12, 25)) + "."
    docs = spark.createDataFrame([(None, line), (1, line + " " + line), (2, None), (3, ""), (4, line), (4, line), (6, "short. same."), (7, "short. same.")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in spans.remove_repeated_spans(docs).collect())
    assert got == [("1", line + " "), ("4", ""), ("4", ""), ("None", "")]
    assert spans.remove_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = docs.withColumn("first", F.lit("x")).withColumn("spans", F.lit(1))
    assert spans.remove_repeated_spans(clash).count() == 4
