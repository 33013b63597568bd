"""ZIP-packaged web archives: WARC members and their indexes inside a ZIP file, read by byte ranges.

A package holds stored (not deflated) members: ``archive/*.warc.gz``, in which
every WARC record is a gzip member of its own, and ``indexes/index.cdxj``, a
line for each record with its member, offset and length. A reader fetches the
tail of the ZIP file, follows the ZIP64 records where there are any, parses the
central directory, fetches the index, and then any record by one range read:
nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.arrow import RangeReader, written
from gneiss.llm.common import fresh_path, table

#: Bytes of WARC data after which a member is closed; bounds a writer's memory.
MEMBER_BYTES, LEVEL = 16 << 20, 6
#: Largest end record with its comment, and what is fetched of the tail first.
_TAIL = 22 + 0xFFFF
_EOCD, _EOCD64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF
_DATE = "2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ZIP -------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    offset: int  # of the local header
    size: int
    method: int
    crc: int


class ZipWriter:
    """Stored members, written one after the other to a binary stream that can't seek.

    Sizes and offsets beyond 32 bits, and member counts beyond 16 bits, go to
    ZIP64 records; force64 writes those always.
    """

    def __init__(self, out, force64: bool = False):
        self.out, self.force64, self.at, self.members = out, force64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, start = name.encode(), zlib.crc32(data), self.at
        wide = self.force64 or len(data) >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = _MAX32 if wide else len(data)
        self._write(struct.pack("<4sHHHHHIIIHH", _LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x2821, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._write(data)
        self.members.append(Member(name, start, len(data), 0, crc))

    def close(self) -> None:
        start = self.at
        for m in self.members:
            raw, wide = m.name.encode(), self.force64 or m.size >= _MAX32 or m.offset >= _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.size, m.offset) if wide else b""
            size, offset = (_MAX32, _MAX32) if wide else (m.size, m.offset)
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x2821, m.crc, size, size, len(raw), len(extra), 0, 0, 0, 0, offset) + raw + extra)
        size, n = self.at - start, len(self.members)
        if self.force64 or n >= _MAX16 or start >= _MAX32 or size >= _MAX32:
            end = self.at
            self._write(struct.pack("<4sQHHIIQQQQ", _EOCD64, 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<4sIQI", _LOCATOR64, 0, end, 1))
            n, size, start = _MAX16, _MAX32, _MAX32
        self._write(struct.pack("<4sHHHHIIH", _EOCD, 0, 0, n, n, size, start, 0))


class ZipReader:
    """The central directory of a ZIP file, and range reads from its stored members."""

    def __init__(self, source: RangeReader):
        self.source = source
        tail_at = max(0, source.size - _TAIL)
        tail = source.read(tail_at, source.size - tail_at)
        at = tail.rfind(_EOCD)
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(_EOCD, 0, at)  # the signature may stand in a comment
        if at < 0:
            raise ValueError("no end of central directory")
        n, size, start = struct.unpack_from("<HII", tail, at + 10)
        end = tail_at + at
        if end >= 20 and (n == _MAX16 or size == _MAX32 or start == _MAX32):
            locator = source.read(end - 20, 20)
            if locator[:4] == _LOCATOR64:
                (record_at,) = struct.unpack_from("<Q", locator, 8)
                record = source.read(record_at, 56)
                if record[:4] != _EOCD64:
                    raise ValueError("no ZIP64 end of central directory")
                n, size, start = struct.unpack_from("<QQQ", record, 32)
        self.members = {m.name: m for m in self._directory(source.read(start, size), n)}
        self._data_at: dict[str, int] = {}

    @staticmethod
    def _directory(raw: bytes, n: int) -> Iterator[Member]:
        at = 0
        for _ in range(n):
            if raw[at : at + 4] != _CENTRAL:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            crc, packed, size, a, b, c = struct.unpack_from("<IIIHHH", raw, at + 16)
            (offset,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + a].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = raw[at + 46 + a : at + 46 + a + b], 0
            while k + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, k)
                if kind == 1:  # holds, in this order, those values that don't fit above
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, k + 4))
                    size = next(wide) if size == _MAX32 else size
                    packed = next(wide) if packed == _MAX32 else packed
                    offset = next(wide) if offset == _MAX32 else offset
                k += 4 + length
            yield Member(name, offset, packed, method, crc)
            at += 46 + a + b + c

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """Bytes of a stored member, all of them by default."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed")
        if name not in self._data_at:
            head = self.source.read(m.offset, 30)
            if head[:4] != _LOCAL:
                raise ValueError(f"{name}: no local header")
            self._data_at[name] = m.offset + 30 + sum(struct.unpack_from("<HH", head, 26))
        length = m.size - start if length is None else length
        if start < 0 or start + length > m.size:
            raise ValueError(f"{length} bytes at {start} are outside of {name}")
        return self.source.read(self._data_at[name] + start, length)


# --- WARC ------------------------------------------------------------------


def warc_record(kind: str, url: str, headers: dict[str, str], payload: bytes) -> bytes:
    """One record of WARC 1.1. A response carries HTTP headers and the payload, a revisit the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {headers['X-Payload-Length']}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = {"WARC-Type": kind, "WARC-Target-URI": url, "WARC-Date": _DATE, **headers, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record, and its HTTP body."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class PackageWriter:
    """Records into one ZIP package."""

    def __init__(self, out, force64: bool = False):
        self.zip, self.data, self.size, self.index, self.n = ZipWriter(out, force64), [], 0, [], 0

    def _name(self) -> str:
        return f"archive/data-{self.n:05d}.warc.gz"

    def add(self, record: bytes, **entry) -> None:
        packed = gzip.compress(record, LEVEL, mtime=0)
        if self.size and self.size + len(packed) > MEMBER_BYTES:
            self._flush()
        self.index.append(json.dumps({"filename": self._name(), "offset": self.size, "length": len(packed), **entry}))
        self.data.append(packed)
        self.size += len(packed)

    def _flush(self) -> None:
        self.zip.add(self._name(), b"".join(self.data))
        self.data, self.size, self.n = [], 0, self.n + 1

    def close(self) -> None:
        if self.data:
            self._flush()
        self.zip.add("indexes/index.cdxj", "".join(x + "\n" for x in self.index).encode())
        self.zip.add("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": m.name, "bytes": m.size} for m in self.zip.members]}).encode())
        self.zip.close()


class PackageReader:
    """Index and records of one package."""

    def __init__(self, uri: str):
        self.source = RangeReader(uri)
        self.zip = ZipReader(self.source)

    def index(self) -> list[dict]:
        return [json.loads(x) for name in sorted(self.zip.members) if name.startswith("indexes/") for x in self.zip.read(name).decode().splitlines()]

    def record(self, entry: dict) -> tuple[dict[str, str], bytes]:
        return parse_record(gzip.decompress(self.zip.read(entry["filename"], entry["offset"], entry["length"])))


# --- on Spark --------------------------------------------------------------


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html) with __refers_to: the page whose response holds the same payload, null for a response.

    Of records with equal payloads of least_bytes or more, that with the
    largest page_id is the response. Null html is an empty payload. Rows that
    repeat the largest page_id are responses too; a null page_id is smaller
    than any other, and payloads of nothing else are all responses.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n")).where(F.col("n") >= least_bytes)
    shared = rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("times")).where("times > 1")
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    out = out.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    out = out.join(shared.withColumnRenamed("sha", "of"), (F.col("sha") == F.col("of")) & (F.octet_length("html") >= least_bytes), "left")
    return out.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("__refers_to"))


def write_packages(pages: DataFrame, least_bytes: int = 0) -> list[str]:
    """Writes a record for each page; the paths of the packages, one for each partition with rows."""
    folder = fresh_path(pages.sparkSession, "packages")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.wacz"
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        with written(path) as out:
            package = PackageWriter(out)
            for batch in (x for some in ([first], batches) for x in some):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = html.encode()
                    url = "".join((url or "about:blank").split())
                    headers = {"WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "X-Payload-Length": str(len(payload))}
                    if refers_to is not None:
                        headers |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    kind = "response" if refers_to is None else "revisit"
                    package.add(warc_record(kind, url, headers, payload), url=url, mime="warc/revisit" if refers_to is not None else "text/html", page_id=page_id)
            package.close()
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return sorted(x.path for x in with_revisits(pages, least_bytes).mapInArrow(write, "path string").collect())  # a row for each package


def read_packages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each record, by range reads through the index. The payload of a revisit is that it refers to, of which it holds digest and length."""
    number = lambda x: None if x == "<urn:page:None>" else int(x.removeprefix("<urn:page:").removesuffix(">"))
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (x for batch in batches for x in batch.column(0).to_pylist()):
            package, rows = PackageReader(path), []
            for entry in package.index():
                headers, body = package.record(entry)
                length, digest, kind = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                if kind == "response":
                    if payload_digest(body) != digest:
                        raise ValueError(f"{path}: {entry} differs from its digest")
                    length = len(body)
                refers_to = number(headers["WARC-Refers-To"]) if kind == "revisit" else None
                rows.append({"page_id": number(headers["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": refers_to})
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            package.source.close()
            yield pa.RecordBatch.from_pylist(rows, schema)

    todo = spark.createDataFrame([(x,) for x in paths], "path string").repartition(max(1, len(paths)))
    return todo.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_zip_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """write_packages of pages, read back: null html is an empty payload; rows that repeat a page_id are records of their own; an empty table gives none."""
    return read_packages(spark, write_packages(table(spark, sf_dir, "pages")))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), x AS (
  SELECT *, max(page_id) OVER (PARTITION BY sha) AS last,
    (SELECT string_agg(CASE substr(sha, i, 1) WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101'
      WHEN '6' THEN '0110' WHEN '7' THEN '0111' WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011' WHEN 'c' THEN '1100' WHEN 'd' THEN '1101'
      WHEN 'e' THEN '1110' ELSE '1111' END, '' ORDER BY i) FROM range(1, 41) r(i)) AS bits FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(16 * CAST(substr(bits, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * k + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * k + 3, 1) AS INT)
      + 2 * CAST(substr(bits, 5 * k + 4, 1) AS INT) + CAST(substr(bits, 5 * k + 5, 1) AS INT) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM x
"""
