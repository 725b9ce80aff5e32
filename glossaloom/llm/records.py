"""Token ids in files of length-delimited binary records, with a separate offset index.

Record: length (uint64), masked checksum of the length (uint32), payload, masked checksum of the payload (uint32), all
little-endian; checksum is zlib's CRC-32, rotated and offset so that a checksum of checksums stays useful.
Payload: flags (uint8: 1 = null id, 2 = ids of 4 bytes), id (int64), count (uint32), ids (2 or 4 bytes each).
Index `<file>.idx`: for each record its offset and its size on disk (two uint64), so a reader can shuffle.

Rows are range-partitioned and sorted by id and a hash of the text, so rows of one id may fill several partitions. A
task begins a new file whenever one has reached `file_bytes`; files have names of their own and a manifest row each. The
manifest is a table in the same folder and readers open only what it names, so the files of lost or repeated task
attempts are never read.

Cases: a null text is empty and has its end id only; null ids come first; rows with one id are all written, side by
side, ordered by their texts' hashes; an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaloom.llm.common import fresh_dir, open_fs, slices, table
from glossaloom.llm.tokens import encoder

MANIFEST = "part long, place long, file string, n_records long, n_ids long"
#: Formats of struct: what precedes a payload, and what a payload begins with.
_HEAD, _PAYLOAD, _PAYLOAD_SIZE = "<QI", "<BqI", 13
#: Bytes that a reader asks for at once, unless one record is longer.
BLOCK = 4 << 20
#: A file that has so many bytes is followed by another.
FILE_BYTES = 256 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview) -> memoryview:
    """The payload of one whole record; ValueError if it is damaged."""
    size, check = struct.unpack_from(_HEAD, data)
    if masked(bytes(data[:8])) != check or len(data) != size + 16:
        raise ValueError("damaged record length")
    payload = data[12 : 12 + size]
    if masked(payload) != struct.unpack_from("<I", data, 12 + size)[0]:
        raise ValueError("damaged record")
    return payload


class _File:
    """A file of records that is being written, with its index."""

    def __init__(self, fs, folder: str, part: int):
        self.fs, self.folder, self.name = fs, folder, f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        fs.create_dir(folder, recursive=True)
        self.out = fs.open_output_stream(f"{folder}/{self.name}", buffer_size=BLOCK)
        self.index, self.size, self.n_ids = array("Q"), 0, 0

    def add(self, record: bytes, n_ids: int) -> None:
        self.out.write(record)
        self.index.extend((self.size, len(record)))
        self.size += len(record)
        self.n_ids += n_ids

    def close(self) -> dict:
        self.out.close()
        with self.fs.open_output_stream(f"{self.folder}/{self.name}.idx") as idx:
            idx.write(np.array(self.index, "<u8").tobytes())
        return {"file": self.name, "n_records": len(self.index) // 2, "n_ids": self.n_ids}


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files and their manifest under path; returns the manifest."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("file", pa.string()), ("n_records", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        wide = enc.dtype.itemsize
        part = TaskContext.get().partitionId()
        fs, folder = open_fs(path)
        file, written = None, []
        for batch in batches:
            for piece in slices(batch, "t"):
                for i, ids in zip(piece.column("i").to_pylist(), enc.encode(piece.column("t").to_pylist())):
                    file = file or _File(fs, folder, part)
                    count = len(ids) // wide + 1
                    file.add(frame(struct.pack(_PAYLOAD, (i is None) | (wide == 4) << 1, i or 0, count) + ids + end), count)
                    if file.size >= file_bytes:
                        written.append(file.close())
                        file = None
        if file:
            written.append(file.close())
        if written:
            yield pa.RecordBatch.from_pylist([{"part": part, "place": k, **row} for k, row in enumerate(written)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(n, "i", "h").sortWithinPartitions("i", "h", "t")
    rows.select("i", "t").mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_records(spark: SparkSession, path: str, shuffle_seed: int | None = None) -> DataFrame:
    """doc_id, start (ids of all records before it in file order), n_tokens, ids (unsigned 32-bit, little-endian).

    With a seed, each file's records are read through its index in a shuffled order; the rows are the same.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    manifest = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = max(1, spark.read.schema(MANIFEST).parquet(f"{path}/manifest").count())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def blocks(index: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, int, list]]:
        """Runs of records that lie side by side, up to BLOCK bytes."""
        run: list[int] = []
        size = 0
        for k in order.tolist():
            if run and (k != run[-1] + 1 or size + int(index[k, 1]) > BLOCK):
                yield int(index[run[0], 0]), size, run
                run, size = [], 0
            run.append(k)
            size += int(index[k, 1])
        if run:
            yield int(index[run[0], 0]), size, run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(path)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{folder}/{row['file']}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                order = np.arange(len(index))
                if shuffle_seed is not None:
                    np.random.default_rng([shuffle_seed, row["part"], row["place"]]).shuffle(order)
                with fs.open_input_file(f"{folder}/{row['file']}") as f:
                    starts = None
                    if shuffle_seed is not None:  # counts follow from the sizes on disk: 16 bytes frame, 13 bytes head
                        flags = f.read_at(13, 0)[12]
                        counts = (index[:, 1] - 16 - _PAYLOAD_SIZE) // (4 if flags & 2 else 2)
                        starts = np.cumsum(counts) - counts
                    at = row["base"]
                    for offset, size, run in blocks(index, order):
                        data, rows = memoryview(f.read_at(size, offset)), []
                        for k in run:
                            lo = int(index[k, 0]) - offset
                            payload = unframe(data[lo : lo + int(index[k, 1])])
                            flags, doc_id, n = struct.unpack_from(_PAYLOAD, payload)
                            ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", n, _PAYLOAD_SIZE).astype("<u4", copy=False)
                            start = at if starts is None else row["base"] + int(starts[k])
                            rows.append((None if flags & 1 else doc_id, start, n, ids.tobytes()))
                            at += n
                        yield batch_of(rows)

    return manifest.repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_dir(spark, "token_records")
    write_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op5_token_records": op5_token_records}
ORACLES: dict[str, str] = {}
