"""Places where a key can meet the texts that hold it.

A key of `tier` characters or more has its anchor where the least of the first grams lies; a text that holds the key has
an anchor at the same characters, because the same grams decide. Key and text give the hash of the characters from there
on that lie within the first `tier` ones of the key. So a text gives a part of its places only (two in 26 for keys of 64
characters or more, two in 10 from 32 on); for keys of up to 31 characters it gives all. Bitmaps of fixed size over the
hashes of keys keep places apart that no key can meet; they drop nothing else.

Near copies share many anchors, but few hold each other. So key and text also tell a byte for every few characters before and
behind the anchor: what a key tells must begin what the text tells. A hash that lies at many places of a text, or in a text
that is cut, tells nothing; then the strings decide.

The shortest keys lie in most texts, and both their number and that of texts grow. A block of them, of bounded size, goes to
all tasks, where texts find them in place: such pairs move nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 8
#: Bits of a bitmap over the hashes of keys (8 MB), and of one of its buckets.
BITS, BUCKET = 1 << 26, 1 << 15
#: The bitmaps: from which tier on, and which bits of a hash. Short keys are few, but all places of texts ask for them; the
#: long ones are most of all keys, and a place must be in three bitmaps (at 23 million keys one would let 29% by, three 2%).
KINDS = ((0, 0), (32, 0), (64, 0), (64, 19), (64, 38))
#: By tier, (characters, bytes) that are told before and behind an anchor: as far as keys reach, and 1,024 characters at most.
BEFORE, BEHIND = {32: (4, 2), 64: (8, 3)}, {8: (1, 7), 16: (1, 15), 32: (4, 9), 64: (16, 64)}
#: Places of a hash in one text that are told apart.
APART = 8
#: Keys below GRAM characters that all tasks get (some 10 MB at most), and bits of the bitmap over their hashes (512 KB).
SHORT, SHORT_BITS = 1 << 18, 1 << 22
#: Characters that are hashed at once.
_PIECE = 1 << 15
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_NONE = np.uint64((1 << 64) - 1)


def tier_of(size: Column) -> Column:
    return F.when(size >= 64, 64).when(size >= 32, 32).when(size >= 16, 16).when(size >= GRAM, GRAM).otherwise(size)


def _window(tier: int) -> int:
    """Grams among which the least one is the anchor."""
    return max(1, tier // 2 - GRAM + 1)


def _reach(tier: int) -> int:
    """Characters from the anchor on that a key of this tier has in any case."""
    return tier - _window(tier) + 1


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * _PIECE + 256, b, np.uint64)]))
    return grow(_BASE), grow(_INVERSE)


def _mixed(h: np.ndarray, tier: int) -> np.ndarray:
    h = h + np.uint64(tier)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class _Places:
    """The characters of some texts behind each other, with hashes of all their substrings."""

    def __init__(self, texts: list[str]):
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.last = np.repeat(self.ends, self.sizes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * _powers()[0][: len(code)])])

    def hashes(self, at: np.ndarray, n: int, tier: int) -> np.ndarray:
        """Of the n characters from each place; the places must have as many."""
        return _mixed((self.sums[at + n] - self.sums[at]) * _powers()[1][at], tier)

    def every(self, n: int, tier: int) -> np.ndarray:
        """Of the n characters from every place that has as many in these texts, whosever they are."""
        size = max(0, len(self.last) - n + 1)
        return _mixed((self.sums[n:] - self.sums[: len(self.sums) - n])[:size] * _powers()[1][:size], tier)

    @cached_property
    def grams(self) -> np.ndarray:
        """The hash of each place's gram; the greatest number where the text ends before."""
        g = np.full(len(self.last), _NONE)
        own = self.every(GRAM, 0)
        g[: len(own)] = own
        g[np.arange(GRAM, len(g) + GRAM) > self.last] = _NONE
        return g


def _sliding(best: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    done = 1
    while done < w:
        step = min(done, w - done)
        x, done = best(x[:-step], x[step:]), done + step
    return x


def _least(tier: int) -> int:
    return max(t for t, _ in KINDS if t <= tier)


def text_places(places: _Places, tier: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of all anchors at which a key of this tier may meet a text; known: the bitmaps."""
    own = [(bits, np.uint64(shift)) for bits, (t, shift) in zip(known, KINDS) if t == _least(tier)]
    w, n = _window(tier), _reach(tier)
    if w == 1:
        h = places.every(n, tier)
        at = _in_all(own, h)
        h, fits = h[at], at + n <= places.last[at]
        return at[fits], h[fits]
    here, g = np.arange(len(places.last)), places.grams
    least = _sliding(np.minimum, np.concatenate([g, np.full(w - 1, _NONE)]), w)
    least[here + (w + GRAM - 1) > places.last] = 0  # no whole window begins here
    anchor = _sliding(np.maximum, np.concatenate([np.zeros(w - 1, np.uint64), least]), w) == g
    at = np.flatnonzero(anchor & (here + n <= places.last))
    h = places.hashes(at, n, tier)
    met = _in_all(own, h)
    return at[met], h[met]


def _in_all(known: list[tuple[np.ndarray, np.uint64]], h: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(_has(known[0][0], h >> known[0][1]))
    for bits, shift in known[1:]:
        at = at[_has(bits, h[at] >> shift)]
    return at


def _has(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & np.uint64(8 * len(known) - 1)
    return (known[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def key_places(places: _Places, tier: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each key's anchor; all keys are of this tier."""
    at, w = places.ends - places.sizes, _window(tier)
    if w > 1:
        at = at + places.grams[at[:, None] + np.arange(w)].argmin(axis=1)
    return at, places.hashes(at, _reach(tier), tier)


def around(places: _Places, at: np.ndarray, tier: int, told: np.ndarray) -> list[pa.Array]:
    """A byte for each whole step of characters, away from each anchor, before and behind it; null where not told."""
    n, end = _reach(tier), places.last[at]
    begin = (places.ends - places.sizes)[np.searchsorted(places.ends, at, side="right")]
    out = []
    for (step, most), room, first, sign in ((BEFORE.get(tier, (1, 0)), at - begin, at, -1), (BEHIND.get(tier, (1, 0)), end - at - n, at + n, 1)):
        count = np.where(told, np.minimum(room // step, most), 0)
        offsets = np.append(0, np.cumsum(count))
        k = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count)
        own = places.hashes(np.repeat(first, count) + (k if sign > 0 else -1 - k) * step, step, tier).astype(np.uint8)
        whole = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(own)])
        out.append(whole if told.all() else pc.if_else(pa.array(told), whole, None))
    return out


class Block:
    """Keys below GRAM characters, by their sizes and hashes."""

    def __init__(self, keys: list[str]):
        by_size: dict[int, list[str]] = {}
        for key in keys:
            by_size.setdefault(len(key), []).append(key)
        self.hashes: dict[int, np.ndarray] = {}
        self.first: dict[int, int] = {}
        self.known = np.zeros(SHORT_BITS // 8, np.uint8)
        ordered: list[str] = []
        for m, own in sorted(by_size.items()):
            h = np.concatenate([key_places(_Places(own[k : k + _PIECE // GRAM]), m)[1] for k in range(0, len(own), _PIECE // GRAM)])
            order = np.argsort(h)
            self.hashes[m], self.first[m] = h[order], len(ordered)
            ordered += [own[k] for k in order]
            bit = h & np.uint64(SHORT_BITS - 1)
            np.bitwise_or.at(self.known, bit >> np.uint64(3), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        self.keys = pa.array(ordered, pa.string())

    def held(self, places: _Places) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, number of the key) of places whose hash a key has, each pair once."""
        found = [np.zeros(0, np.int64)]
        for m, own in self.hashes.items():
            h = places.every(m, m)
            at = np.flatnonzero(_has(self.known, h))
            at = at[at + m <= places.last[at]]
            low, high = (np.searchsorted(own, h[at], side=side) for side in ("left", "right"))
            times = high - low  # more than one only if hashes collide
            begin = np.repeat(low - np.cumsum(times) + times, times)
            of = np.searchsorted(places.ends, np.repeat(at, times), side="right")
            found.append(of * len(self.keys) + self.first[m] + begin + np.arange(len(begin)))
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.keys)))


def short_keys(keys: DataFrame) -> tuple[int, list[str]]:
    """(m, all keys of up to m characters), m as large as GRAM and SHORT let it be; keys(key) of different rows."""
    size = F.char_length("key")
    counts = dict(keys.where(size.between(1, GRAM - 1)).groupBy(size).count().collect())
    m = max(m for m in range(GRAM) if sum(counts.get(k, 0) for k in range(1, m + 1)) <= SHORT)
    return m, [r.key for r in keys.where(size.between(1, m)).select("key").collect()]


def holding(texts: DataFrame, short: list[str]) -> DataFrame:
    """(text, keys): texts(text) that hold some of these keys below GRAM characters, with all of them."""
    block = texts.sparkSession.sparkContext.broadcast(Block(short))
    schema = pa.schema([("text", pa.string()), ("keys", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")

            def rows(of: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
                own, begin = np.unique(of, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(of)), pa.int32()), block.value.keys.take(pa.array(key)))
                return pa.RecordBatch.from_arrays([column.take(pa.array(own)), lists], schema=schema)

            begin, total, pieces = 0, 0, []
            for k, value in enumerate(column):
                text = value.as_py()
                if len(text) > _PIECE:  # alone, in pieces
                    cuts = [block.value.held(_Places([text[c : c + _PIECE + GRAM]]))[1] for c in range(0, len(text), _PIECE)]
                    key = np.unique(np.concatenate(cuts))
                    yield rows(np.full(len(key), k), key)
                    text = ""
                pieces.append(text)
                total += len(text)
                if total >= _PIECE or k + 1 == len(column):
                    of, key = block.value.held(_Places(pieces))
                    yield rows(of + begin, key)
                    begin, total, pieces = k + 1, 0, []

    return texts.where("text is not null").select("text").mapInArrow(run, "text string, keys array<string>")


def filed(keys: DataFrame) -> DataFrame:
    """(kid, m, tier, h, before, behind): hash, characters, tier and anchor of keys(key)."""
    schema = pa.schema([("kid", pa.int64()), ("m", pa.int32()), ("tier", pa.int32()), ("h", pa.int64()), ("before", pa.binary()), ("behind", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiers = batch.column("tier").to_numpy(zero_copy_only=False)
            for tier in np.unique(tiers).tolist():
                own = np.flatnonzero(tiers == tier)
                step, most = BEHIND.get(tier, (1, 0))
                longest = tier + step * most  # a key's first characters hold its anchor
                for begin in range(0, len(own), _PIECE // longest):
                    part = batch.take(pa.array(own[begin : begin + _PIECE // longest]))
                    places = _Places([k[:longest] for k in part.column("key").to_pylist()])
                    at, h = key_places(places, tier)
                    told = around(places, at, tier, np.ones(len(at), bool))
                    yield pa.RecordBatch.from_arrays([part.column("kid"), part.column("m"), part.column("tier"), pa.array(h.view(np.int64)), *told], schema=schema)

    size = F.char_length("key")
    return keys.where(size >= 1).select("key", F.xxhash64("key").alias("kid"), size.alias("m"), tier_of(size).alias("tier")).mapInArrow(run, "kid long, m int, tier int, h long, before binary, behind binary")


def bitmaps(filed: DataFrame) -> np.ndarray:
    """The bits of the hashes of keys, apart for each of KINDS; at most BITS / BUCKET rows a kind come to the driver."""
    bit = lambda shift: F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(BITS - 1))
    least = F.when(F.col("tier") >= 64, 64).when(F.col("tier") >= 32, 32).otherwise(0)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("least"), bit(shift).alias("bit")) for k, (t, shift) in enumerate(KINDS)]))
    own = filed.select(least.alias("least"), kinds.alias("k")).where("least = k.least")
    rows = own.select("k.kind", F.shiftright("k.bit", 15).alias("bucket"), F.col("k.bit").bitwiseAND(F.lit(BUCKET - 1)).alias("at")).groupBy("kind", "bucket").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = np.zeros((len(KINDS), BITS // BUCKET, BUCKET // 8), np.uint8)
    for r in rows:
        out[r.kind, r.bucket] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(len(KINDS), -1)


def perhaps_among(rows: DataFrame, column: str, asked: DataFrame) -> DataFrame:
    """Rows whose hash may be among those of asked(column), by a bitmap of BITS bits; no row is moved for it."""
    split = lambda h: (F.shiftright(h.bitwiseAND(F.lit(BITS - 1)), 15), h.bitwiseAND(F.lit(BUCKET - 1)))
    bucket, at = split(F.col(column))
    bits = asked.select(bucket.alias("__bucket"), at.alias("__at")).groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int"))
    return rows.join(F.broadcast(bits), bucket == F.col("__bucket")).where(met.bitwiseAND(F.lit(1)) == 1).drop("__bucket", "__bits")


def brought(texts: DataFrame, filed: DataFrame) -> DataFrame:
    """(id, n, h, before, behind): hash and characters of texts(text), with each of its anchors that a key may meet."""
    sc = texts.sparkSession.sparkContext
    tiers = sorted(r[0] for r in filed.select("tier").distinct().collect())  # GRAM + 3 at most
    known = sc.broadcast(bitmaps(filed))
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("before", pa.binary()), ("behind", pa.binary())])

    def group(pieces: list[str], rows: list[int], ids: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        places, row = _Places(pieces), np.array(rows)
        for tier in tiers:
            at, h = text_places(places, tier, known.value)
            of = row[np.searchsorted(places.ends, at, side="right")]
            order = np.lexsort((h, of))
            at, of, h = at[order], of[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
            times = np.diff(np.append(np.flatnonzero(new), len(h)))
            told = (np.repeat(times, times) <= APART) & (sizes[of] <= _PIECE)
            kept = new | told
            at, of, h, told = at[kept], of[kept], h[kept], told[kept]
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(sizes[of], pa.int32()), pa.array(h.view(np.int64)), *around(places, at, tier, told)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n"))
            pieces, rows, total = [], [], 0
            for k, value in enumerate(batch.column("text")):
                text = value.as_py()
                for begin in range(0, len(text), _PIECE):
                    pieces.append(text[begin : begin + _PIECE + 64])  # keys look at 64 characters at most
                    rows.append(k)
                    total += len(pieces[-1])
                    if total >= _PIECE:
                        yield from group(pieces, rows, ids, sizes)
                        pieces, rows, total = [], [], 0
            if pieces:
                yield from group(pieces, rows, ids, sizes)

    return texts.where("text is not null").select(F.xxhash64("text").alias("id"), F.char_length("text").alias("n"), "text").mapInArrow(run, "id long, n int, h long, before binary, behind binary")


def met(texts: DataFrame, filed: DataFrame) -> DataFrame:
    """(id, kid) of texts and keys that may be held in them, each pair once; strings decide."""
    t, k = brought(texts, filed).alias("t"), filed.alias("k")
    fits = F.col("t.before").isNull() | (F.startswith("t.before", "k.before") & F.startswith("t.behind", "k.behind"))
    return t.join(k, (F.col("t.h") == F.col("k.h")) & (F.col("n") > F.col("m")) & fits).select("id", "kid").distinct()
