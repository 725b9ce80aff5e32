"""Components of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

MinHash finds candidates: a text has 32 keys of 4 minima each, and two of similarity 0.8 share none of them with a chance
of (1 - 0.8 ** 4) ** 32, 5 in 100 million. Candidates are verified by the exact similarity of their sets, so a shared key
alone links nothing. A posting of a large group isn't paired with itself: each member is compared with one root per
posting first. The sets of postings whose members are then still in different components meet again by their rarest
shingles only (prefix filter, which is exact), so members of a large group that are too different from all others form
no pairs. Equal sets are one entry of the index.

Cases: texts of up to five words are one shingle; null and empty texts and texts of white space have an empty set, and
these link to each other only; rows with a null id are ignored when the smallest id of a component is sought.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaloom.llm.common import slices, stored
from glossaloom.llm.graph import connected_components

WORDS, KEYS, MINIMA = 5, 32, 4
#: Shingles whose hashes are taken through all functions at once.
_CHUNK = 1 << 11
_RANDOM = np.random.default_rng(42)
_XOR = _RANDOM.integers(0, 1 << 64, KEYS * MINIMA, np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, KEYS * MINIMA, np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingles' hashes, ascending."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxh64_intdigest(joined)], np.uint64)
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    n = len(w) - words + 1
    cuts = map(slice, (ends - sizes)[:n].tolist(), ends[words - 1 :].tolist())
    return np.unique(np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(0)), np.uint64, n))


def set_id(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes())


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """The set's KEYS keys; a key of one place never equals one of another."""
    from xxhash import xxh64_intdigest

    least = np.full(KEYS * MINIMA, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, ((hashes[None, k : k + _CHUNK] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    return np.array([xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(KEYS, MINIMA))], np.uint64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sid, n, keys): the id, size and keys of each row's set."""
    schema = pa.schema([("id", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets = [shingle_hashes(t) for t in part.column("t").to_pylist()]
                sid = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
                keys = np.array([keys_of(s) for s in sets], np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * KEYS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sid), pa.array([len(s) for s in sets], pa.int32()), lists], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(rows, "id long, sid long, n int, keys array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(sid, hashes) of texts(t)."""
    schema = pa.schema([("sid", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets = [shingle_hashes(t) for t in part.column("t").to_pylist()]
                sid = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema)

    return texts.select("t").mapInArrow(rows, "sid long, hashes array<long>")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets with a similarity of 0.8 or more: 5 shared >= 4 (n + m - shared)."""
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y")), "b")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _close(n: str, m: str):
    """Sizes that a similarity of 0.8 allows."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _rarest(sets: DataFrame) -> DataFrame:
    """(h, sid, n, most): the shingles by which a set may meet another of similarity 0.8 or more.

    Two such sets of n and m shingles share at least 4 (n + m) / 9. In an order common to all, the rarest first, their first
    shared shingle is therefore at a place i with m <= (5 n - 9 i) / 4 = most in the one, and likewise in the other.
    """
    rows = stored(sets.select("sid", F.size("hashes").alias("n"), F.explode("hashes").alias("h")), "shingles")
    counts = stored(rows.groupBy("h").agg(F.count("*").alias("df")), "shingle_counts")
    place = F.row_number().over(Window.partitionBy("sid").orderBy("df", "h")) - 1
    placed = rows.join(counts.where("df > 1"), "h", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("i", place)
    placed = placed.withColumn("most", F.floor((5 * F.col("n") - 9 * F.col("i")) / 4))
    return stored(placed.where("df > 1 and 5 * most >= 4 * n").select("h", "sid", "n", "most"), "rarest")


def _mixed(rarest: DataFrame, parts: DataFrame) -> DataFrame:
    """rarest with the part of each set, where sets of several parts meet."""
    placed = rarest.join(parts, "sid")
    mixed = placed.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("h")
    return stored(placed.join(mixed, "h", "left_semi"), "mixed_rarest")


def _to_central(mixed: DataFrame) -> DataFrame:
    """The pairs (a, b) of each set with the one that holds the shingle earliest, as a set near which many others lie does."""
    roots = mixed.groupBy("h").agg(F.max(F.struct(F.col("most") - F.col("n"), "sid", "n", "most", "part")).alias("r"))
    pairs = mixed.join(roots, "h").where("part != r.part and n <= r.most and r.n <= most")
    return pairs.select(F.least("sid", "r.sid").alias("a"), F.greatest("sid", "r.sid").alias("b")).distinct()


def _across(mixed: DataFrame) -> DataFrame:
    """All pairs (a, b) of sets in different parts that meet; the smaller is filed by the band of its size, the larger asks for the bands that it may meet."""
    band = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1.02)))
    small = mixed.where("most >= n").withColumn("band", band(F.col("n")))
    bands = F.sequence(band(F.ceil(4 * F.col("n") / 5)), band(F.least("n", "most")))
    large = mixed.select("h", *[F.col(c).alias(f"{c}2") for c in ("sid", "part", "n", "most")], F.explode(bands).alias("band"))
    fit = "part != part2 and (n < n2 or n = n2 and sid < sid2) and n <= most2 and n2 <= most and 5 * n >= 4 * n2"
    return small.join(large, ["h", "band"]).where(fit).select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()


def _parts(sids: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, part) of all sids by the links found so far."""
    roots = connected_components(links)
    return stored(sids.join(roots, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("root", "sid").alias("part")), "parts")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for every row."""
    rows = stored(sketches(docs, id_col, text_col), "sketches")
    distinct = stored(rows.groupBy("sid").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys")), "distinct_sets")
    dealt = distinct.select("sid", "n", F.explode("keys").alias("key")).repartition("key")
    order = F.struct(F.xxhash64("sid", "key"), "sid", "n")
    shared = dealt.groupBy("key").agg(F.min(order).alias("r"), F.count("*").alias("m")).where("m > 1")
    postings = stored(dealt.join(shared, "key").select("key", "sid", "n", F.col("r.sid").alias("root"), F.col("r.n").alias("root_n")), "postings")

    wanted = postings.select("sid").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    first = rows.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("id").alias("id"))
    named = texts.join(first.where("id is not null").select("id").distinct(), "id", "left_semi").unionByName(texts.where("id is null"))
    sets = stored(_sets(named).join(wanted, "sid", "left_semi").dropDuplicates(["sid"]), "sets")

    tried = stored(postings.where(F.col("sid") != F.col("root")).where(_close("n", "root_n")).select(F.least("sid", "root").alias("a"), F.greatest("sid", "root").alias("b")).distinct(), "tried")
    links = stored(_similar(tried, sets), "links")

    part_of = _parts(wanted, links)
    placed = postings.select("key", "sid").join(part_of, "sid")
    split = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    unsettled = stored(placed.join(split, "key", "left_semi").select("sid").distinct(), "unsettled")
    rarest = _rarest(sets.join(unsettled, "sid", "left_semi"))
    central = stored(_to_central(_mixed(rarest, part_of)).join(tried, ["a", "b"], "left_anti"), "central")
    links = stored(links.unionByName(_similar(central, sets)), "more_links")
    rest = stored(_across(_mixed(rarest, _parts(unsettled, links))), "across").join(tried.unionByName(central), ["a", "b"], "left_anti")
    all_links = links.unionByName(_similar(rest, sets))

    roots = stored(connected_components(all_links), "set_roots")
    linked = distinct.join(roots, distinct.sid == roots.node, "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    # only linked sets are grouped; the others are components of their own
    grouped = linked.join(roots.select(F.col("root").alias("r")).distinct(), F.col("root") == F.col("r"), "left_semi").groupBy("root").agg(F.min("least").alias("c"))
    of_set = linked.join(grouped, "root", "left").select("sid", F.coalesce("c", "least").alias("component_id"))
    return rows.join(of_set, "sid").select("id", "component_id")
