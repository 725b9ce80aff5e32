from __future__ import annotations

import heapq
import random
import re
import zlib
from functools import lru_cache
from hashlib import md5, sha256

import duckdb
import pytest

from glossaloom.llm import fim, repair

BLANK = " \t\n\x0b\x0c\r"


# Structure repair.


def by_enumeration(kinds):
    """(cost, audit): all sequences of edits in order of cost, the ASCII-least of the first cost whose roles fit the grammar."""
    heap, found, best = [(0, "", 0, "")], [], None
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if best is not None and cost > best:
            break
        if i == len(kinds) and re.fullmatch("(s?(ua)+)?", roles):
            best = cost
            found.append(audit)
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        for role in "ua":
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + role))
        if i < len(kinds):
            kind = kinds[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles))
            if kind != "X":
                more = int(kind.isupper())
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + kind.lower()))
                for role in "ua":
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + role))
    return best, min(found)


def by_recursion(kinds):
    """The same by the best (cost, audit) of every (row, state), for longer conversations."""
    @lru_cache(None)
    def best(i, state, inserts):
        options = []
        if i == len(kinds) and state in ("", "a"):
            options.append((0, ""))

        def go(cost, initial, role, step):
            if re.fullmatch("s?(ua)*u?", {"": "", "s": "s", "u": "u", "a": "ua"}[state] + role) if role else True:
                c, a = best(i + step, role or state, 0 if step else inserts + 1)
                options.append((cost + c, initial + a))

        if inserts < 3:
            for role in "ua":
                go(2, "I", role, 0)
        if i < len(kinds):
            go(3, "D", "", 1)
            if kinds[i] != "X":
                more = int(kinds[i].isupper())
                if kinds[i].lower() in "sua":
                    go(more, "K", kinds[i].lower(), 1)
                for role in "ua":
                    go(2 + more, "R", role, 1)
        return min(options, default=(10**9, ""))

    for i in range(len(kinds), 0, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def test_shortest_paths_equal_enumeration():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 5):
        for _ in range(60):
            kinds = "".join(rng.choice("suaoSUAOX") for _ in range(n))
            cost, audit, state = repair.solve(kinds)
            got = (cost + repair.AT_END[state], audit + repair.tail(state))
            assert got == by_enumeration(kinds) == by_recursion(kinds), kinds


def test_chunks_compose():
    rng = random.Random(6)
    for _ in range(80):
        pieces = ["".join(rng.choice("suaoSUAOX") for _ in range(rng.randint(0, 6))) for _ in range(4)]
        ends = [repair.AT_END]
        for p in reversed(pieces[1:]):
            m = repair.matrix(p)
            ends.insert(0, tuple(min(m[4 * s + e] + ends[0][e] for e in range(4)) for s in range(4)))
        state, cost, audit = repair.START, 0, ""
        for p, e in zip(pieces, ends):
            c, a, state = repair.solve(p, e, state)
            cost, audit = cost + c, audit + a
        assert (cost + repair.AT_END[state], audit + repair.tail(state)) == by_recursion("".join(pieces))


def expected(rows, damage=True):
    """A summary per conversation of rows (conv_id, turn, role, text), one conversation after the other."""
    by_conv = {}
    for conv, turn, role, text in rows:
        own = by_conv.setdefault(conv, [])
        blank = lambda x: " " if x is None else str(x)
        role, text = blank(role), blank(text)
        fault = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20 if damage else 9
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds, met, count = "", set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            end = text.rstrip(BLANK)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in met else "truncated" if end not in ".!?" else ""
            met.add((role, text))
            if fault:
                count[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += "X" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        cost, audit = by_recursion(kinds)
        repaired, k, roles = [], 0, ""
        for e in audit:
            if e != "I":
                _, role, text = own[k]
                k += 1
            if e == "D":
                continue
            name = role if e == "K" else "assistant" if roles.endswith("u") else "user"
            roles += name[0]
            repaired.append(f"{name}:{'' if e == 'I' else text}")
        assert re.fullmatch("(s?(ua)+)?", roles)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha256("\n".join(repaired).encode()).hexdigest())
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
DDL = "conv_id long, turn long, role string, text string"


def summed(spark, rows, ddl=DDL, **limits):
    frame = spark.createDataFrame(rows, ddl)
    found = repair.summaries(*repair.repair(repair.damaged(frame), **limits)).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in found}


def test_whole_table_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = repair.op11_structure_repair(spark, sf).collect()
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in found} == expected(rows)


def odd_rows():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "Assistant"]
    texts = ["Yes.", "No!", "why", "Really?", "", " \t", None, "Yes.", "a\nb.", "x" * 3000 + "."]
    rows = [(rng.choice([1, 2, 3, None, 7]), rng.choice([None, *range(-3, 40)]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += [(9, t, ("user", "assistant")[t % 2], f"Turn {t % 50}.") for t in range(300)]  # one long conversation
    rows += [(10, 5, "user", "The same."), (10, 5, "user", "The same.")] * 40
    return rows


@pytest.mark.parametrize("limits", [{}, {"chunk_rows": 7}, {"chunk_bytes": 5000}, {"chunk_rows": 1}])
def test_nulls_ties_and_long_conversations(spark, limits):
    rows = odd_rows()
    assert summed(spark, rows, **limits) == expected(rows)


def test_a_conversation_that_is_dropped_keeps_its_row(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert summed(spark, [(gone, 0, "user", "Hello.")]) == {gone: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}


def test_no_conversations_and_clashing_columns(spark):
    assert summed(spark, []) == {}
    rows = [(1, k, ("user", "assistant")[k % 2], "Well.", "y", 3) for k in range(4)]
    assert summed(spark, rows, DDL + ", h string, live int") == expected([r[:4] for r in rows])


# Fill in the middle.


def simple_cut(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_fim_whole_table_equals_brute_force_and_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        n, form, p, m, out = simple_cut(r.doc_id, r.text)
        want[r.doc_id] = (n, form, p, m, sha256(out.encode()).hexdigest(), sha256((r.text or "").encode()).hexdigest())
    frame = fim.op13_fill_in_middle(spark, sf)
    names = frame.columns
    assert {r[0]: tuple(r[1:]) for r in frame.collect()} == want
    duckdb.sql(f"create or replace view documents as select * from read_parquet('{sf}/documents.parquet')")
    assert {r[0]: tuple(r[1:]) for r in duckdb.sql(fim.ORACLES["op13_fill_in_middle"]).select(*names).fetchall()} == want
    assert {w[1] for w in want.values()} >= {"psm", "spm"}


def test_fim_odd_rows(spark):
    texts = [None, "", "a", "\n", "\n\n\n", "one\ntwo\nthree", "ends<\nS>\n<\n", "has <M> in it\nx", "ü\n😀\r\nü", "x" * 1_000_000 + "\n" + "y" * 10, "same\nsame\n", "same\nsame\n"]
    rows = [(None if k == 3 else k // 2, t, "c", 1) for k, t in enumerate(texts * 8)]
    found = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, form string, n int"))
    again = found.withColumn("back", fim.restored(found.output, found.form)).collect()
    got = sorted((str(r.id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in again)
    want = sorted((str(i), *simple_cut(i, t)) for i, t, _, _ in rows)
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in want]
    assert sorted(r.back for r in again) == sorted(t or "" for _, t, _, _ in rows)
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_fim_shares(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "'a\nb\nc' as text")
    count = lambda **k: {r.form: r["count"] for r in fim.fill_in_middle(docs, **k).groupBy("form").count().collect()}
    assert count(fim_percent=0) == {"plain": 400}
    assert 150 < count(fim_percent=50)["plain"] < 250
    assert set(count(spm_percent=100)) == {"spm"}
