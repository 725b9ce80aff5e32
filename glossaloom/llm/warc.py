"""WARC archives as a Spark data source in Python, and deduplicated writing of pages.

Writing: `df.write.format("warc").mode("append").save(path)` writes a file per task, and further ones beyond ROLL bytes,
each under a name of its own, and commits the names in a manifest file; files of lost or repeated attempts are not in it
and never read. Columns: record_id (long), target_uri, record_type (response or revisit), refers_to (long), payload
(binary or null), payload_bytes (long), payload_digest (hex SHA-1). The payload of a response is deflated inside its
record as Transfer-Encoding: gzip, so the digest is that of the entity, record headers stay plain text, and a reader
can step over a block without decoding it. Record ids (URNs) follow from id, address, type and digest, and a revisit names
its response in WARC-Refers-To.

Reading: one partition per archive file. Without a manifest all .warc and .warc.gz files of the folder (or the one file)
are read, of any origin: WARC/1.0 and 1.1, a member per record or whole files compressed, chunked or compressed
bodies, digests in hex or base32 or none, any record type. Filters on the header columns (=, in, null tests, comparisons
of numbers) are taken over by the reader: headers are parsed first, and the block of a record that fails is skipped by
its Content-Length. With option payload=false no payload is decoded at all. Payloads are checked against SHA-1, SHA-256 and
MD5 digests. Filter pushdown needs spark.sql.python.filterPushdown.enabled, which `read_archives` sets.

Cases: columns come from headers, so payload_bytes and record_id are null in archives of other origin; the payload is
the entity of an HTTP message with its encodings taken off, else the whole block, and null for revisits; a null html is
an empty payload; payloads under 1000 bytes are never revisits; rows with one page_id are written as records of their
own (with one URN if they are equal), and of equal payloads with the same largest page_id all are responses; a null
page_id never has revisits refer to it (an equal payload with an id is the response, or else all are responses); an
empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from glossaloom.llm.common import fresh_dir, open_fs, stored, table

SCHEMA = "record_id long, target_uri string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, record_urn string, refers_to_urn string"
#: Columns that a record's headers hold.
HEADERS = ("record_id", "target_uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "record_urn", "refers_to_urn")
MANIFEST = "manifest-"
BUFFER = 4 << 20
#: Bytes after which a task begins another file.
ROLL = 256 << 20
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:glossaloom:warc")
_EPOCH = "1970-01-01T00:00:00Z"


def urn(*of) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, json.dumps(of))}>"


def write_record(row) -> bytes:
    """One WARC/1.1 record."""
    response, digest = row["record_type"] == "response", row["payload_digest"]
    body = b""
    if response:
        body = gzip.compress(bytes(row["payload"] or b""), 1, mtime=0)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"Transfer-Encoding: gzip\r\n" if response else b"") + b"\r\n"
    uri = "".join(c for c in row["target_uri"] or "" if c >= " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {urn(row['record_id'], digest) if response and row['record_id'] is not None else urn(row['record_id'], digest, row['record_type'], uri)}",
        f"WARC-Date: {_EPOCH}",
        *([f"WARC-Target-URI: {uri}"] if row["target_uri"] is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {row['payload_bytes']}",
        *([f"X-Record-Key: {row['record_id']}"] if row["record_id"] is not None else []),
        *([] if response else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        *([f"WARC-Refers-To: {urn(row['refers_to'], digest)}", f"X-Refers-To-Key: {row['refers_to']}"] if row["refers_to"] is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def header_fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:] if line)}


def hex_digest(value: str | None) -> str | None:
    """The digest of a header in hex, without its algorithm; base32 is the usual form of SHA-1."""
    if not value:
        return None
    name, _, digest = value.rpartition(":")
    if name.lower().replace("-", "") in ("sha1", "") and len(digest) == 32:
        try:
            return base64.b32decode(digest.upper()).hex()
        except ValueError:
            return digest.lower()
    return digest.lower()


def _columns(fields: dict[str, str]) -> dict:
    number = lambda k: int(fields[k]) if k in fields else None
    return {"record_id": number("x-record-key"), "target_uri": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "refers_to": number("x-refers-to-key"), "payload_bytes": number("x-payload-length"), "payload_digest": hex_digest(fields.get("warc-payload-digest")), "record_urn": fields.get("warc-record-id"), "refers_to_urn": fields.get("warc-refers-to")}


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return b"".join(out) if out else body  # some writers keep the header of a body that they unchunked
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return b"".join(out) if out else body
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _inflated(body: bytes, coding: str) -> bytes:
    if coding in ("gzip", "x-gzip"):
        return gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
    if coding == "deflate":
        try:
            return zlib.decompress(body)
        except zlib.error:
            return zlib.decompress(body, -15)
    return body


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The payload of a record's block, checked against its digest if there is one."""
    forms = [block]
    if fields.get("content-type", "").lower().startswith("application/http") and b"\r\n\r\n" in block:
        head, _, body = block.partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])}
        forms = [body]
        for coding in reversed([c.strip() for c in http.get("transfer-encoding", "").split(",") if c.strip()]):
            forms.append(_unchunked(forms[-1]) if coding == "chunked" else _inflated(forms[-1], coding))
        for coding in reversed([c.strip() for c in http.get("content-encoding", "").split(",") if c.strip()]):
            forms.append(_inflated(forms[-1], coding))
    name, digest = fields.get("warc-payload-digest", "").partition(":")[0].lower().replace("-", ""), hex_digest(fields.get("warc-payload-digest"))
    if digest and name in ("sha1", "sha256", "md5") and all(hashlib.new(name, f).hexdigest() != digest for f in reversed(forms)):
        raise ValueError(f"damaged payload of record {fields.get('warc-record-id')}")
    return forms[-1]


class _Bytes:
    """Reads a file forwards in buffers; skipped ranges beyond the buffer are never read."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data, self.base = file, size, 0, b"", 0

    def _fill(self, n: int) -> None:
        rest = self.data[self.at - self.base :] if self.base <= self.at <= self.base + len(self.data) else b""
        self.data = rest + self.file.read_at(max(n - len(rest), min(BUFFER, self.size - self.at - len(rest))), self.at + len(rest))
        self.base = self.at

    def ended(self) -> bool:
        return self.at >= self.size

    def skip(self, n: int) -> None:
        self.at += n

    def take(self, n: int) -> bytes:
        if not self.base <= self.at or self.at + n > self.base + len(self.data):
            self._fill(n)
        got = self.data[self.at - self.base : self.at - self.base + n]
        if len(got) < n:
            raise ValueError("truncated WARC record")
        self.at += n
        return got

    def until(self, mark: bytes) -> bytes:
        want = 4096
        while True:
            want = min(want, self.size - self.at)
            if self.at + want > self.base + len(self.data) or self.at < self.base:
                self._fill(want)
            k = self.data.find(mark, self.at - self.base)
            if k >= 0:
                got = self.data[self.at - self.base : k]
                self.at = self.base + k + len(mark)
                return got
            if self.at + want >= self.size:
                raise ValueError("truncated WARC header")
            want *= 4


class _Inflated:
    """The same over a gzip file of one or more members, read forwards."""

    def __init__(self, file, size: int):
        self.file, self.size, self.raw, self.read = file, size, b"", 0
        self.data, self.inflater = bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.inflater.eof:
            self.raw, self.inflater = self.inflater.unused_data, zlib.decompressobj(31)
        if not self.raw:
            if self.read >= self.size:
                return False
            self.raw = self.file.read_at(min(1 << 20, self.size - self.read), self.read)
            self.read += len(self.raw)
        self.data += self.inflater.decompress(self.raw)
        self.raw = b""
        return True

    def ended(self) -> bool:
        while not self.data:
            if not self._more():
                return True
        return False

    def take(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self._more():
                raise ValueError("truncated WARC record")
        got = bytes(self.data[:n])
        del self.data[:n]
        return got

    def skip(self, n: int) -> None:
        while n:
            if self.ended():
                return
            step = min(n, len(self.data))
            del self.data[:step]
            n -= step

    def until(self, mark: bytes) -> bytes:
        while (k := self.data.find(mark)) < 0:
            if not self._more():
                raise ValueError("truncated WARC header")
        return self.take(k + len(mark))[:k]


def _passes(f: Filter, row: dict) -> bool:
    v = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return v is None
    if v is None:
        return False
    if isinstance(f, EqualTo):
        return v == f.value
    if isinstance(f, In):
        return v in f.value
    if isinstance(f, GreaterThan):
        return v > f.value
    if isinstance(f, GreaterThanOrEqual):
        return v >= f.value
    if isinstance(f, LessThan):
        return v < f.value
    if isinstance(f, LessThanOrEqual):
        return v <= f.value
    return True


@dataclass
class ArchiveFile(InputPartition):
    name: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, decode: bool):
        self.path, self.decode, self.filters = path, decode, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[ArchiveFile]:
        from pyarrow import fs as pfs

        fs, folder = open_fs(self.path)
        if fs.get_file_info(folder).type == pfs.FileType.File:
            return [ArchiveFile(folder)]
        names: list[str] = []
        infos = sorted(fs.get_file_info(pfs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path)
        manifests = [i for i in infos if i.base_name.startswith(MANIFEST)]
        for info in manifests:
            with fs.open_input_stream(info.path) as f:
                names += [f"{folder}/{n}" for n in json.loads(f.read())]
        if not manifests:
            names = [i.path for i in infos if i.base_name.lower().endswith((".warc", ".warc.gz"))]
        return [ArchiveFile(n) for n in names] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile) -> Iterator[tuple]:
        if not partition.name:
            return
        fs, _ = open_fs(self.path)
        with fs.open_input_file(partition.name) as file:
            size = file.size()
            data = (_Inflated if size > 1 and file.read_at(2, 0) == b"\x1f\x8b" else _Bytes)(file, size)
            while not data.ended():
                begin = data.take(1)
                if begin in b"\r\n":  # line ends between records
                    continue
                fields = header_fields(begin + data.until(b"\r\n\r\n"))
                length = int(fields["content-length"])
                row = _columns(fields)
                if not all(_passes(f, row) for f in self.filters):
                    data.skip(length)
                    continue
                payload = None
                if row["record_type"] == "revisit" or not self.decode:
                    data.skip(length)
                else:
                    payload = payload_of(fields, data.take(length))
                yield (row["record_id"], row["target_uri"], row["record_type"], row["refers_to"], payload, row["payload_bytes"], row["payload_digest"], row["record_urn"], row["refers_to_urn"])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        fs, folder = open_fs(self.path)
        names, out, size = [], None, 0
        for row in rows:
            if out is None:
                fs.create_dir(folder, recursive=True)
                names.append(f"part-{uuid.uuid4().hex}.warc")
                out, size = fs.open_output_stream(f"{folder}/{names[-1]}", buffer_size=1 << 20), 0
                info = b"software: glossaloom\r\n"
                out.write(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {_EPOCH}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
            record = write_record(row)
            out.write(record)
            size += len(record)
            if size >= ROLL:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = open_fs(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m is not None for n in m.names]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing to undo: what no manifest names is never read."""


class WarcDataSource(DataSource):
    """Options: path; payload (default true)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """The records to write: of equal payloads of at least so many bytes the one with the largest id is the response."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(uri_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    # only payloads that occur again are joined; the table is written first, so Spark knows its size when it plans the join
    again = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("record_id").alias("keeper")).where("n > 1").select(F.col("payload_digest").alias("d"), "keeper")
    again = stored(again, "repeated_payloads")
    rows = rows.join(again, F.col("payload_digest") == F.col("d"), "left")
    revisit = F.coalesce(F.col("record_id") != F.col("keeper"), F.col("record_id").isNull() & F.col("keeper").isNotNull(), F.lit(False))
    return rows.select("record_id", "target_uri", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest")


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    pages.sparkSession.dataSource.register(WarcDataSource)
    records(pages, **columns).write.format("warc").mode("append").save(path)


def op9_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path).where(F.col("record_type").isin("response", "revisit"))
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op9_warc_source": op9_warc_source}
ORACLES = {
    "op9_warc_source": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN k.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND p.payload_bytes >= 1000
"""
}
