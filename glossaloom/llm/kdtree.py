"""Exact top-k search by inner product over KD-trees, one per shard of at most `shard_rows` vectors.

Components x become floor(256 * x). A task cuts its rows into shards and builds a tree per shard: the widest dimension
is split at its median until a leaf holds at most `leaf_rows` vectors, and each node keeps its tight bounding box. The
trees are written to the shared folder, and so are the queries, in blocks of at most `block_rows` that tasks pack.
A search task holds the shards of its partition and reads one block of queries after the other. A query walks the tree
of a shard best first: of the nodes it has reached it opens the one whose box allows the greatest inner product, and
stops when no box reaches its kth score. That score propagates from shard to shard of the task. All queries of a block
take their steps together, in numpy. Neither vectors nor queries pass through the driver, and nothing is broadcast.

Cases: vectors that are null, empty or hold a null or non-finite component take no part; queries need not be rows of
the searched table; only vectors of a query's length are its candidates; rows with the query's id are not its
candidates; a repeated query row is answered once per row; ties go to the smaller id, equal rows are listed each; null
ids take no part; 256 * x saturates at the largest double, and scores at the ends of a long (such vectors are searched
without a tree); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaloom.llm.common import fresh_dir, open_fs, stored, table

INDEX = "n int, dim int, wide boolean, ids binary, points binary, nodes binary, low binary, high binary"
BLOCK = "dim int, keys binary, ids binary, points binary"
_LONG = (-(2**63), 2**63 - 1)
_MOST = float(np.finfo(np.float64).max)


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part; v holds doubles without a fraction."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    large = lambda x: F.greatest(F.least(x * 256, F.lit(_MOST)), F.lit(-_MOST))  # noqa: E731  large doubles are whole
    whole = F.transform("v", lambda x: F.when(F.abs(x) < F.lit(2.0**40), F.floor(x * 256).cast("double")).otherwise(large(x)))
    return rows.where(finite).select("id", whole.alias("v"))


def build_tree(points: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the points, leaf by leaf; nodes (begin, end, first child or -1) from the root, whose children lie side by side; the least and greatest corner of each node's box."""
    order, nodes, low, high = np.arange(len(points)), [[0, len(points), -1]], [], []
    for node in nodes:  # grows while it is walked
        a, b, _ = node
        own = points[order[a:b]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        if b - a > leaf_rows:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, int((high[-1] - low[-1]).argmax())], mid)]
            node[2] = len(nodes)
            nodes += [[a, a + mid, -1], [a + mid, b, -1]]
    return order, np.array(nodes, "<i4"), np.array(low), np.array(high)


def _by_length(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """Per length of v: the length, the other columns of its rows and v as a matrix."""
    lists = batch.column("v")
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, [batch.column(c).to_numpy()[rows] for c in columns], flat[(ends[rows] - dim)[:, None] + np.arange(dim)]


def _packed(batches: Iterator[pa.RecordBatch], most: int, columns: list[str], pack) -> Iterator[pa.RecordBatch]:
    """pack(columns, v) of up to so many rows of one length at a time."""
    held: dict[int, list] = {}
    for batch in batches:
        for dim, own, v in _by_length(batch, *columns):
            kept = held.setdefault(dim, [np.empty(0, c.dtype) for c in own] + [np.empty((0, dim))])
            kept[:] = [np.concatenate(pair) for pair in zip(kept, [*own, v])]
            while len(kept[-1]) >= most:
                yield pack(*(c[:most] for c in kept))
                kept[:] = [c[most:] for c in kept]
    for kept in held.values():
        if len(kept[-1]):
            yield pack(*kept)


def build_index(rows: DataFrame, shard_rows: int, leaf_rows: int) -> DataFrame:
    schema = pa.schema([("n", pa.int32()), ("dim", pa.int32()), ("wide", pa.bool_()), *((c, pa.binary()) for c in ("ids", "points", "nodes", "low", "high"))])

    def shard(ids: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        wide = bool(np.abs(points).max() >= 2**31 - 1)
        order, nodes, low, high = build_tree(points, len(points) if wide else leaf_rows)
        kind = "<f8" if wide else "<i4"
        values = [len(ids), points.shape[1], wide, *(a.tobytes() for a in (ids[order].astype("<i8"), points[order].astype(kind), nodes, low.astype(kind), high.astype(kind)))]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    return rows.mapInArrow(lambda batches: _packed(batches, shard_rows, ["id"], shard), INDEX)


def write_queries(rows: DataFrame, path: str, block_rows: int) -> None:
    """The queries (id, v) in blocks, a Parquet file each; a query's key names its row. A manifest names the blocks, so those of lost attempts are never read."""
    keys = pa.schema([("dim", pa.int32()), *((c, pa.binary()) for c in ("keys", "ids", "points"))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(path)

        def block(ids: np.ndarray, key: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            name = f"block-{uuid.uuid4().hex}.parquet"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{name}") as out:
                pq.write_table(pa.table([pa.array([x], f.type) for x, f in zip((v.shape[1], key.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), v.astype("<f8").tobytes()), keys)], schema=keys), out)
            return pa.RecordBatch.from_pydict({"name": [name]})

        yield from _packed(batches, block_rows, ["id", "key"], block)

    rows.withColumn("key", F.monotonically_increasing_id()).mapInArrow(write, "name string").write.parquet(f"{path}/manifest")


def query_blocks(path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, keys, ids, vectors) of one block after the other."""
    fs, folder = open_fs(path)
    for name in sorted(pq.read_table(f"{folder}/manifest", filesystem=fs).column("name").to_pylist()):
        with fs.open_input_file(f"{folder}/{name}") as f:
            row = pq.read_table(f).to_pylist()[0]
        yield row["dim"], np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["points"], "<f8").reshape(-1, row["dim"])


class Best:
    """The best k (score, id) of each query so far, and the score that a candidate must reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.query, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        again = np.isin(self.query, query)
        q, i, s = (np.concatenate([a[again], b]) for a, b in ((self.query, query), (self.id, ids), (self.score, score)))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        full = rank == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], s[full])
        keep = rank < self.k
        self.query, self.id, self.score = (np.concatenate([a[~again], b[keep]]) for a, b in ((self.query, q), (self.id, i), (self.score, s)))


def search_shard(ids: np.ndarray, points: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, qids: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Best-first walks of all queries through one tree. Queries and points are floats that hold all sums exactly."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = np.full((len(queries), len(nodes)), -np.inf)  # of nodes that a query has reached and not opened
    bound[:, 0] = up @ high[0] + down @ low[0]
    alive = np.arange(len(queries))
    while len(alive):
        at = bound[alive].argmax(axis=1)
        on = bound[alive, at] >= best.floor[alive]
        on &= bound[alive, at] > -np.inf
        alive, at = alive[on], at[on]
        bound[alive, at] = -np.inf
        by_node = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(at[by_node]) > 0, True]) if len(at) else []
        found = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            q, (begin, end, child) = alive[by_node[a:b]], nodes[at[by_node[a]]]
            if child >= 0:
                bound[q, child : child + 2] = up[q] @ high[child : child + 2].T + down[q] @ low[child : child + 2].T
                continue
            score = queries[q] @ points[begin:end].T
            hit_q, hit_p = np.nonzero((score >= best.floor[q][:, None]) & (ids[begin:end][None, :] != qids[q][:, None]))
            if len(hit_q):
                found.append((q[hit_q], ids[begin:end][hit_p], score[hit_q, hit_p]))
        if found:
            best.add(*(np.concatenate(c) for c in zip(*found)))


def _exact_type(a: float, b: float, dim: int):
    """The float type whose sums of products of such sizes are exact, else None."""
    most = a * b * dim
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else None


def _wide_scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact products in Python's integers, saturated to a long."""
    big = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    return np.array([[min(max(int(x), _LONG[0]), _LONG[1]) for x in row] for row in big(queries) @ big(points).T], dtype=object)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, leaf_rows: int = 64, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k best rows of vectors."""
    spark = vectors.sparkSession
    index = stored(build_index(quantised(vectors, id_col, vector_col), shard_rows, leaf_rows), "kd_trees")
    path = fresh_dir(spark, "query_blocks")
    write_queries(quantised(queries, id_col, vector_col), path, block_rows)
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = []
        for batch in batches:
            for r in range(batch.num_rows):
                n, dim, wide = (batch.column(c)[r].as_py() for c in ("n", "dim", "wide"))
                kind = "<f8" if wide else "<i4"
                ids, points, nodes, low, high = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("ids", "<i8"), ("points", kind), ("nodes", "<i4"), ("low", kind), ("high", kind)))
                shards.append((dim, ids, points.reshape(n, dim), nodes.reshape(-1, 3), low.reshape(-1, dim), high.reshape(-1, dim)))
        for dim, keys, qids, q in query_blocks(path) if shards else ():
            best, exact, most = Best(np.full(len(q), -np.inf), k), [], np.abs(q).max()
            for _, ids, points, nodes, low, high in (s for s in shards if s[0] == dim):
                kind = _exact_type(most, np.abs(points).max(), dim)
                if kind is not None:
                    search_shard(ids, points.astype(kind), nodes, low.astype(kind), high.astype(kind), qids, q.astype(kind), best)
                    continue
                score = _wide_scores(q, points)
                for row in range(len(q)):
                    own = sorted((-s, i) for s, i in zip(score[row], ids.tolist()) if i != qids[row])[:k]
                    exact += [(int(keys[row]), int(qids[row]), i, -s) for s, i in own]
            yield pa.RecordBatch.from_arrays([pa.array(keys[best.query]), pa.array(qids[best.query]), pa.array(best.id), pa.array(best.score.astype(np.int64))], schema=schema)
            if exact:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*exact), schema)], schema=schema)

    found = index.mapInArrow(search, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES = {"op4_kdtree_topk": op4_kdtree_topk}
ORACLES = {
    "op4_kdtree_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}
