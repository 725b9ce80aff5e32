"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs n + n*n / (6 * width): the linear layers and the attention of a transformer of that width.
Documents go, in descending length, each to the lowest-cost sequence that has room for it; one that fits nowhere is cut
at the room of the emptiest sequence and its rest queues again. This happens in windows of about `window_tokens` tokens
of one partition, so no shuffle moves the texts and a task holds one window. The sequences of a window are as many full
ones as its tokens fill, and sequences of powers of two for the rest, so nothing is padded.

Cases: a null or empty text is one end token; rows with one id are packed as documents of their own; a null id stays
null; an empty table gives no rows; other columns of the input are not read. `sequence_id` is unique, not dense.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.llm.common import slices, table
from glossaloom.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"


def piece_cost(n, width: int = 1024):
    return n + n * n / (6.0 * width)


def pack(lengths: list[int], capacity: int = 4096, width: int = 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths; every sequence is filled."""
    total = sum(lengths)
    rooms = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    room, cost = np.array(rooms, np.int64), np.zeros(len(rooms))
    queue = [(-n, doc, 0) for doc, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    pieces = []
    while queue:
        n, doc, start = heapq.heappop(queue)
        n = -n
        fits = room >= n
        if fits.any():
            seq, take = int(np.where(fits, cost, np.inf).argmin()), n
        else:
            seq = int(room.argmax())
            take = int(room[seq])
            heapq.heappush(queue, (take - n, doc, start + take))
        pieces.append((doc, start, take, seq, rooms[seq] - int(room[seq])))
        room[seq] -= take
        cost[seq] += piece_cost(take, width)
    return pieces


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, width: int = 1024, window_tokens: int = 1 << 20) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        wide = enc.dtype.itemsize
        base, made = TaskContext.get().partitionId() << 40, 0
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            lengths = [len(t) // wide for t in texts]
            cols: list[list] = [[] for _ in schema]
            top = -1
            for doc, start, n, seq, offset in pack(lengths, capacity, width):
                piece = np.frombuffer(texts[doc], enc.dtype, n, start * wide).astype("<u4").tobytes()
                for col, v in zip(cols, (ids[doc], start, n, piece, lengths[doc], base + made + seq, offset, piece_cost(n, width))):
                    col.append(v)
                top = max(top, seq)
            made += top + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            for part in slices(batch, "t"):
                for i, b in zip(part.column("i").to_pylist(), enc.encode(part.column("t").to_pylist())):
                    ids.append(i)
                    texts.append(b + end)
                    held += len(b) // wide + 1
                    if held >= window_tokens:
                        yield flush()
                        ids, texts, held = [], [], 0
        if texts:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(rows, SCHEMA)


def op1_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


QUERIES = {"op1_cost_balanced_packing": op1_cost_balanced_packing}
ORACLES: dict[str, str] = {}
