"""SimHash fingerprints and near-duplicate components through an inverted index over positional bytes.

A 64-bit fingerprint has 8 positional bytes. Two that differ in at most `bits` bits share at least 8 - bits of them: the
guaranteed minimum. Postings of single positional bytes would hold 1/256 of all fingerprints each, and tallying pairs
over them would be quadratic. The index therefore has one posting per set of 8 - bits positions and their bytes: two
fingerprints meet in a posting exactly if their tally of shared positional bytes reaches the minimum (count filter).
A posting leaves `bits` bytes free, at most 65,536 different fingerprints for 2 bits, however many documents there are.
Within it the differing bits are verified and each linked set is joined to its smallest fingerprint, never all pairs.
Equal fingerprints are one entry of the index. Components come from the links by star steps.

Cases: null and empty texts and texts of white space have fingerprint zero and link like any other; rows with one id
keep their own rows; a null id keeps its row and is ignored when the smallest id of a component is sought; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.llm.common import slices, stored, table
from glossaloom.llm.graph import connected_components

#: Shingles whose bits are counted at once.
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over shingles of `words` words, repeats included; 0 without a word."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    n = len(w) - words + 1
    begin, end = (ends - sizes)[:n], ends[words - 1 :]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        cuts = map(slice, begin[k : k + _CHUNK].tolist(), end[k : k + _CHUNK].tolist())
        m = min(_CHUNK, n - k)
        h = np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(seed)), "<u8", m)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                fps = np.array([fingerprint(t, words) for t in part.column("t").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps.view(np.int64))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(rows, "id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_posting(fps: np.ndarray, free: tuple[int, ...], bits: int) -> np.ndarray:
    """For different fingerprints (unsigned, ascending) that agree outside the free bytes: the index of the smallest one each is linked to, step by step."""
    m = len(fps)
    label = np.arange(m)
    if m <= 256:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
        while True:
            new = np.where(near, label[None, :], m).min(axis=1)
            if (new == label).all():
                return label
            label = new
    value = np.zeros(m, np.int64)
    for k, byte in enumerate(free):
        value |= ((fps >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64) << 8 * k
    place = np.full(1 << 8 * len(free), -1)
    place[value] = label
    flips = [sum(1 << b for b in c) for k in range(1, bits + 1) for c in combinations(range(8 * len(free)), k)]
    while True:
        new = label.copy()
        for flip in flips:
            other = place[value ^ flip]
            new = np.where(other >= 0, np.minimum(new, new[other]), new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Edges (a, b) between the different fingerprints of distinct(fp), enough to connect all that differ in at most `bits` bits."""
    sets = list(combinations(range(8), bits))
    masks = [_signed(((1 << 64) - 1) & ~sum(255 << 8 * p for p in free)) for free in sets]
    index = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("pos", "key"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(pos: np.ndarray, key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (key[1:] != key[:-1])])
            sizes = np.diff(np.r_[starts, len(pos)])
            a, b = [], []
            for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                own = np.sort(fps[s : s + n].view(np.uint64))
                label = link_posting(own, sets[int(pos[s])], bits)
                moved = label != np.arange(n)
                a.append(own[moved])
                b.append(own[label[moved]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], schema=schema)

        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            cols = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, ("pos", "key", "fp"))]
            if not len(cols[0]):
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            last = int(np.argmax(same))  # sorted: the last posting may go on in the next batch
            yield from edges(*(c[:last] for c in cols)) if last else ()
            held = [c[last:] for c in cols]
        if len(held[0]):
            yield from edges(*held)

    return index.repartition("pos", "key").sortWithinPartitions("pos", "key").mapInArrow(links, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """(id, fp, component_id) for every row."""
    rows = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct_fingerprints")
    roots = stored(connected_components(near_links(distinct.select("fp"), bits)), "fingerprint_roots")
    linked = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # only linked fingerprints are grouped; the others are components of their own
    grouped = linked.join(roots.select(F.col("root").alias("r")).distinct(), F.col("root") == F.col("r"), "left_semi").groupBy("root").agg(F.min("least").alias("c"))
    of_fp = linked.join(grouped, "root", "left").select("fp", F.coalesce("c", "least").alias("component_id"))
    return rows.join(of_fp, "fp").select("id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLES: dict[str, str] = {}
