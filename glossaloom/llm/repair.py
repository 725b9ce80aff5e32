"""Structure repair of conversations: the cheapest edits that make the roles alternate, by Dial's shortest paths.

A conversation's rows in order of turn form a layered graph: a node is (rows read, state of the role grammar), an edit is
an arc of cost 0 to 3. Dial's bucket queue gives each node's distance to the end; then a walk over tight arcs (those that
lie on a shortest path), the ASCII-least initial first, gives the audit. In each state an initial leads to one node only.

The grammar `(s?(ua)+)?` has four states: START, after a system row, after a user row, after an assistant row.

Rows are sorted over the cluster by conversation and turn, and cut into chunks of at most CHUNK_ROWS rows and CHUNK_BYTES
of text. A conversation that lies within one partition and one chunk is solved there. Any other, however long, is solved
by chunks: each gives the least cost between its entry and exit states (a 4 x 4 matrix, by Dial from each exit), matrices
compose from the end to the distances at every chunk's end, and walks compose from the beginning. So no task holds more
than a chunk of texts; only the SHA-256 of a conversation, which is serial, reads its chunks one after the other.

Cases: null roles and texts are one space; null turns come first; rows of one turn are in order of the MD5 of their role
and text, so equal rows are adjacent; a null conversation id is a conversation; a conversation whose rows are all dropped
gives zeros, an empty audit and the hash of nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.llm.common import slices, stored, table

BLANK = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Where a row of this initial may follow, and what an inserted or reroled row is in each state.
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Distances to the end of a conversation behind its last row.
AT_END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40
CHUNK_ROWS, CHUNK_BYTES = 1024, 1_000_000
LEGAL = frozenset(("su", "ua", "au"))


def row_arcs(kind: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits of a row. A kind is the row's role initial, in upper case if the row is truncated; o is any other role, X a row that must go."""
    yield "D", DELETE, state
    if kind != "X":
        more = TRUNCATED if kind.isupper() else 0
        if (state, kind.lower()) in KEEPS:
            yield "K", KEEP + more, KEEPS[state, kind.lower()]
        yield "R", REROLE + more, NEXT[state]


#: Arcs into each state, by kind: (state before, cost).
_INTO = {k: [[(p, c) for p in STATES for _, c, q in row_arcs(k, p) if q == s] for s in STATES] for k in "suaoSUAOX"}
_ARCS = {k: [sorted(row_arcs(k, p)) for p in STATES] for k in "suaoSUAOX"}


def distances(kinds: str, ends: tuple[int, ...]) -> list[int]:
    """The distance of node 4 * i + state, i rows read, to the end, from where the last layer's distances are `ends`."""
    n = len(kinds)
    best = [FAR] * (4 * n) + list(ends)
    near = [d for d in ends if d < FAR]
    low = min(near)
    buckets: list[list[int]] = [[] for _ in range(max(near) - low + 4)]  # no arc costs more than 3: nodes wait in a ring of buckets
    ring, waiting, at = len(buckets), 0, low
    for s in STATES:
        if ends[s] < FAR:
            buckets[(ends[s] - low) % ring].append(4 * n + s)
            waiting += 1
    while waiting:
        bucket = buckets[(at - low) % ring]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if best[node] != at:
                continue
            i, s = divmod(node, 4)
            before = [(4 * i + p, INSERT) for p in STATES if NEXT[p] == s] if i < n else []
            if i:
                before += [(4 * (i - 1) + p, c) for p, c in _INTO[kinds[i - 1]][s]]
            for p, c in before:
                if at + c < best[p]:
                    best[p] = at + c
                    buckets[(at + c - low) % ring].append(p)
                    waiting += 1
        at += 1
    return best


def walk(kinds: str, best: list[int], state: int) -> tuple[str, int]:
    """(audit, state behind the last row) of the lexicographically least shortest path from a state."""
    out, i = [], 0
    while i < len(kinds):
        own = best[4 * i + state]
        for initial, cost, to in sorted([*_ARCS[kinds[i]][state], ("I", INSERT, NEXT[state])]):
            after = 4 * (i + (initial != "I")) + to
            if best[after] + cost == own:
                break
        out.append(initial)
        state, i = to, i + (initial != "I")
    return "".join(out), state


@lru_cache(1 << 14)
def solve(kinds: str, ends: tuple[int, ...] = AT_END, state: int = START) -> tuple[int, str, int]:
    """(cost down to `ends`, audit, last state)."""
    best = distances(kinds, ends)
    audit, last = walk(kinds, best, state)
    return best[state] - ends[last], audit, last


def tail(state: int) -> str:
    """The inserts behind the last row."""
    return "I" * (AT_END[state] // INSERT)


def matrix(kinds: str) -> list[int]:
    """The least costs from entry to exit state, row by row."""
    by_exit = [distances(kinds, tuple(0 if s == e else FAR for s in STATES)) for e in STATES]
    return [by_exit[e][s] for s in STATES for e in STATES]


def applied(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str], int]:
    """The repaired rows of an audit, and the state behind them."""
    out_roles, out_texts, i = [], [], 0
    for e in audit:
        role, text = (None, "") if e == "I" else (roles[i], texts[i])
        i += e != "I"
        if e == "D":
            continue
        state = KEEPS[state, role[:1]] if e == "K" else NEXT[state]
        out_roles.append(role if e == "K" else NAMES[state])
        out_texts.append(text)
    return out_roles, out_texts, state


def kinds_of(roles: list[str], texts: list[str], seen: list[bool]) -> tuple[str, int, int, int]:
    """(kinds, blank, duplicate, truncated): each row's first fault counts."""
    out, blank, duplicate, truncated = [], 0, 0, 0
    for role, text, again in zip(roles, texts, seen):
        end = text.rstrip(BLANK)[-1:]
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not end or again:
            blank += not end
            duplicate += bool(end)
            initial = "X"
        elif end not in ".!?":
            truncated += 1
            initial = initial.upper()
        out.append(initial)
    return "".join(out), blank, duplicate, truncated


_STRINGS, _LONGS = pa.list_(pa.string()), pa.list_(pa.int64())
#: A chunk: its place; whether its conversation may go on elsewhere; what it adds up to; its rows, or its repaired rows and audit.
_CHUNK = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("open", pa.bool_()), ("n", pa.int64()), ("turns", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
    ("kinds", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", _STRINGS), ("texts", _STRINGS), ("hashes", _STRINGS),
])
_CHUNK_DDL = "conv_id long, part long, chunk long, open boolean, n long, turns long, least long, most long, illegal long, first string, last string, kinds string, blank long, duplicate long, truncated long, cost long, audit string, roles array<string>, texts array<string>, hashes array<string>"


def _chunk(conv, part: int, number: int, rows: list[tuple], is_open: bool) -> dict:
    turns, roles, texts, hashes = ([r[k] for r in rows] for k in range(4))
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    out = {"conv_id": conv, "part": part, "chunk": number, "open": is_open, "n": len(rows), "turns": len(set(known)), "least": min(known, default=None), "most": max(known, default=None)}
    out |= {"illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first": initials[0] if rows else None, "last": initials[-1] if rows else None}
    if is_open:
        return out | {"roles": roles, "texts": texts, "hashes": hashes}
    met: set[str] = set()
    seen = [h in met or bool(met.add(h)) for h in hashes]
    kinds, blank, duplicate, truncated = kinds_of(roles, texts, seen)
    cost, audit, state = solve(kinds)
    more = tail(state)
    roles, texts, _ = applied(audit + more, START, roles, texts)
    return out | {"kinds": kinds, "blank": blank, "duplicate": duplicate, "truncated": truncated, "cost": cost + AT_END[state], "audit": audit + more, "roles": roles, "texts": texts}


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of a few MB of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(map(len, row.get("texts") or ()))
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of rows(conv_id, turn, role, text, live) in order; those of conversations that begin and end in one are solved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def made() -> Iterator[dict]:
            conv, held, size, number, begun, first = None, [], 0, 0, False, True
            pieces = 0  # chunks of this conversation before the one that is held
            for batch in batches:
                for piece in slices(batch, "text"):
                    for c, *row, live in zip(*(piece.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "h", "live"))):
                        new = not begun or c != conv
                        if new and begun:
                            yield _chunk(conv, part, number, held, first or pieces > 0)
                            first, number = False, number + 1
                        if new:
                            conv, held, size, pieces, begun = c, [], 0, 0, True
                        if not live:
                            continue
                        if held and (len(held) >= chunk_rows or size + len(row[2]) > chunk_bytes):
                            yield _chunk(conv, part, number, held, True)
                            held, size, pieces, number = [], 0, pieces + 1, number + 1
                        held.append(row)
                        size += len(row[2])
            if begun:  # the next partition may go on with it
                yield _chunk(conv, part, number, held, True)

        yield from _batches(made(), _CHUNK)

    keyed = rows.select("conv_id", "turn", "role", "text", "live", F.md5(F.concat_ws(":", F.char_length("role"), "role", "text")).alias("h"))
    # equal rows are split as well: the last key tells them apart, and their order doesn't matter
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("h")]
    spread = keyed.withColumn("__no", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("__no")).drop("__no")
    return spread.sortWithinPartitions(*order).mapInArrow(run, _CHUNK_DDL)


_PLACE = ["conv_id", "part", "chunk"]


def _streamed(df: DataFrame, each, schema: pa.Schema, ddl: str, backwards: bool = False) -> DataFrame:
    """Rows of df(conv_id, part, chunk, ...) conversation by conversation in order of place, one at a time: each(state, row) gives (state, row); the state is None at the beginning of a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, state = False, None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv:
                    begun, conv, state = True, row["conv_id"], None
                state, made = each(state, row)
                out.append(made)
            yield pa.RecordBatch.from_pylist(out, schema)

    place = [F.col("conv_id")] + [F.col(c).desc() if backwards else F.col(c) for c in ("part", "chunk")]
    return df.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(run, ddl)


def _mapped(df: DataFrame, each, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(map(each, batch.to_pylist()), schema)

    return df.mapInArrow(run, ddl)


def _seen_before(open_chunks: DataFrame) -> DataFrame:
    """(part, chunk, seen): the hashes that earlier chunks of the conversation hold. A hash is one row per chunk, so a hot text is no hot key."""
    own = open_chunks.select(*_PLACE, F.explode(F.array_distinct("hashes")).alias("h"))
    first = own.groupBy("conv_id", "h").agg(F.min(F.struct("part", "chunk")).alias("first"), F.count("*").alias("m")).where("m > 1")
    first = first.select(F.col("conv_id").alias("of"), F.col("h").alias("same"), "first")
    later = own.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("same"))).where("struct(part, chunk) != first")
    return later.groupBy("part", "chunk").agg(F.collect_list("h").alias("seen"))


def _solve_open(chunked: DataFrame) -> DataFrame:
    """The chunks of conversations of several chunks, solved."""
    open_chunks = chunked.where("open")
    flagged = open_chunks.join(_seen_before(open_chunks), ["part", "chunk"], "left")

    def classify(row: dict) -> dict:
        met = set(row["seen"] or ())
        seen = [h in met or bool(met.add(h)) for h in row["hashes"]]
        kinds, blank, duplicate, truncated = kinds_of(row["roles"], row["texts"], seen)
        return {k: row[k] for k in _PLACE} | {"kinds": kinds, "blank": blank, "duplicate": duplicate, "truncated": truncated, "costs": matrix(kinds)}

    kind_schema = pa.schema([*[_CHUNK.field(k) for k in (*_PLACE, "kinds", "blank", "duplicate", "truncated")], ("costs", _LONGS)])
    kinds = stored(_mapped(flagged.select(*_PLACE, "hashes", "roles", "texts", "seen"), classify, kind_schema, "conv_id long, part long, chunk long, kinds string, blank long, duplicate long, truncated long, costs array<long>"), "chunk_kinds")

    def ends(after, row):
        after = after or AT_END
        before = tuple(min(FAR, *(row["costs"][4 * s + e] + after[e] for e in STATES)) for s in STATES)
        return before, {k: row[k] for k in _PLACE} | {"ends": list(after)}

    ends_schema = pa.schema([*[_CHUNK.field(k) for k in _PLACE], ("ends", _LONGS)])
    at_ends = _streamed(kinds.select(*_PLACE, "costs"), ends, ends_schema, "conv_id long, part long, chunk long, ends array<long>", backwards=True)
    placed = stored(kinds.join(at_ends.drop("conv_id"), ["part", "chunk"]), "chunk_ends")

    def exits(row: dict) -> dict:
        best = distances(row["kinds"], tuple(row["ends"]))
        return {k: row[k] for k in _PLACE} | {"exits": [walk(row["kinds"], best, s)[1] if best[s] < FAR else -1 for s in STATES]}

    exit_schema = pa.schema([*[_CHUNK.field(k) for k in _PLACE], ("exits", _LONGS)])

    def entries(state, row):
        state = START if state is None else state
        return row["exits"][state], {k: row[k] for k in ("part", "chunk")} | {"entry": state}

    entry_schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("entry", pa.int64())])
    walked = _mapped(placed.select(*_PLACE, "kinds", "ends"), exits, exit_schema, "conv_id long, part long, chunk long, exits array<long>")
    entered = _streamed(walked, entries, entry_schema, "part long, chunk long, entry long")
    rest = [c for c in _CHUNK.names if c not in ("kinds", "blank", "duplicate", "truncated", "cost", "audit", "hashes")]
    known = placed.join(entered, ["part", "chunk"]).drop("conv_id", "costs")

    def solved(row: dict) -> dict:
        cost, audit, _ = solve(row["kinds"], tuple(row["ends"]), row["entry"])
        roles, texts, _ = applied(audit, row["entry"], row["roles"], row["texts"])
        return {k: row[k] for k in _CHUNK.names if k in row} | {"cost": cost, "audit": audit, "roles": roles, "texts": texts}

    return _mapped(open_chunks.select(*rest).join(known, ["part", "chunk"]), solved, _CHUNK, _CHUNK_DDL)


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The repaired conversations of rows(conv_id, turn, role, text, live), in chunks: (those of one chunk, the others).

    A row that isn't live only names its conversation. In order of (part, chunk), the chunks of a conversation give its
    repaired roles and texts and its audit; the inserts behind its last row are left to `summaries` where there are several.
    """
    chunked = stored(chunks(rows, chunk_rows, chunk_bytes), "chunks")
    return chunked.where("not open"), _solve_open(chunked)


_SUMMARY = pa.schema([("conv_id", pa.int64()), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_SUMMARY_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation of solved chunks that come in order."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for piece in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                yield from piece.to_pylist()

    def made() -> Iterator[dict]:
        begun, s = False, {}
        for row in rows():
            if not begun or row["conv_id"] != s["conv_id"]:
                if begun:
                    yield ended(s)
                begun, s = True, {"conv_id": row["conv_id"], "turns": 0, "least": None, "most": None, "last": None, "state": START, "audit": [], "hash": sha256(), "some": False, **dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)}
            for k in ("blank", "duplicate", "truncated", "illegal", "cost"):
                s[k] += row[k]
            if row["first"] is not None:
                s["illegal"] += s["last"] is not None and s["last"] + row["first"] not in LEGAL
                s["last"] = row["last"]
            if row["least"] is not None:
                s["turns"] += row["turns"] - (s["most"] == row["least"])
                s["least"] = row["least"] if s["least"] is None else s["least"]
                s["most"] = row["most"]
            s["audit"].append(row["audit"])
            add(s, row["roles"], row["texts"])
        if begun:
            yield ended(s)

    def add(s: dict, roles: list[str], texts: list[str]) -> None:
        for role, text in zip(roles, texts):
            s["hash"].update(("\n" * s["some"] + f"{role}:{text}").encode())
            s["some"] = True
            s["state"] = {"a": ASSISTANT, "u": USER, "s": SYSTEM}[role[:1]]

    def ended(s: dict) -> dict:
        more = tail(s["state"])
        s["cost"] += AT_END[s["state"]]
        roles, texts, _ = applied(more, s["state"], [], [])
        add(s, roles, texts)
        gaps = 0 if s["least"] is None else s["most"] - s["least"] + 1 - s["turns"]
        return {k: s[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")} | {"gaps": gaps, "audit": "".join([*s["audit"], more]), "repaired_sha256": s["hash"].hexdigest()}

    yield from _batches(made(), _SUMMARY)


def summaries(whole: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation of what `repair` gives."""
    used = [*_PLACE, "turns", "least", "most", "first", "last", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "roles", "texts"]
    dealt = pieces.select(*used).repartition("conv_id").sortWithinPartitions(*_PLACE)
    return whole.select(*used).mapInArrow(_summarise, _SUMMARY_DDL).unionByName(dealt.mapInArrow(_summarise, _SUMMARY_DDL))


def damaged(conversations: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, live) with faults planted by crc32(conv_id:turn): dropped, emptied, truncated, repeated or reroled."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank(F.col("role")).alias("role"), blank(F.col("text")).alias("text"))
    fault = F.crc32(F.concat(blank(F.col("conv_id")), F.lit(":"), blank(F.col("turn")))) % 20
    rows = own.withColumn("fault", fault).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))))
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role: Column = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("live"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(*repair(damaged(table(spark, sf_dir, "conversations"))))


QUERIES = {"op11_structure_repair": op11_structure_repair}
ORACLES: dict[str, str] = {}
