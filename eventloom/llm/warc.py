"""Operator 10, WARC records in ZIP packages, read by ranges without extraction.

Writing: of pages with equal payloads of ``LEAST`` bytes or more, that with the smallest page_id is a response and the
others are revisits of it. Each task appends gzip members, one a record, to a ``.warc.gz`` and lines to an index; both are
stored (not deflated) members of a ZIP archive in the shared folder. A manifest names the archives of the tasks that
succeeded, so that a lost executor's half-written ones are never read.

Reading: the end record (ZIP64's too) and the central directory are read from the tail, the stored archive members and
their indexes are located, and records are read by range, a few megabytes at a time. Payload digests are verified.

Nulls and edge cases: null html is an empty payload; a null page_id counts as larger than any other; repeated rows with
one page_id are one response and revisits of it; short payloads are all responses; an empty table writes nothing. Extra
columns are left alone, whatever their names. Payloads of any length are one record; an archive is closed once it holds
``ARCHIVE`` bytes. Control characters and blanks of a URL are percent-encoded in the archive, as a header is one line.

Paths are opened with pyarrow's file systems, as Spark has no range reads for Python.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import Bloom, located, place, read, small_batches
from eventloom.shared import materialize, work_dir

LEAST, ARCHIVE, READ = 100, 32 << 20, 4 << 20
#: Bytes of archives that a task reads.
SHARE = 128 << 20

# Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_END, _END64, _LOCATOR = b"PK\5\6", b"PK\6\6", b"PK\6\7"
_ENTRY, _LOCAL = b"PK\1\2", b"PK\3\4"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(1, wbits=31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the full payload's size of one record."""
    data = zlib.decompressobj(wbits=31).decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    return headers, payload, int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1])


class ArchiveWriter:
    """Collects records; each archive holds data/NAME.warc.gz and indexes/NAME.cdxj, both stored."""

    def __init__(self, folder: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self._open()

    def _open(self) -> None:
        self.data, self.index = bytearray(), []

    def add(self, page_id: int | None, member: bytes) -> None:
        self.index.append(json.dumps({"page": page_id, "offset": len(self.data), "length": len(member)}))
        self.data += member

    def close(self) -> tuple[str, int, int]:
        """Name, size and records of the archive."""
        name, out = uuid.uuid4().hex, io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            with z.open(zipfile.ZipInfo(f"data/{name}.warc.gz"), "w", force_zip64=True) as f:
                f.write(self.data)
            z.writestr(zipfile.ZipInfo(f"indexes/{name}.cdxj"), "\n".join(self.index))
        with self.fs.open_output_stream(f"{self.folder}/{name}.zip") as f:
            f.write(out.getbuffer())
        done = (f"{name}.zip", out.tell(), len(self.index))
        self._open()
        return done


class ArchiveReader:
    """A ZIP archive by range reads. f has size(), seek() and read(); members: name -> (offset, length) of stored data."""

    def __init__(self, f):
        self.f = f
        self.members = dict(self._directory())

    def read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        data = self.f.read(n)
        if len(data) != n:
            raise ValueError("the archive ends early")
        return data

    def _directory(self) -> Iterator[tuple[str, tuple[int, int]]]:
        size = self.f.size()
        tail_at = max(0, size - 22 - 65535 - 20)
        tail = self.read(tail_at, size - tail_at)
        k = tail.rfind(_END)
        while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
            k = tail.rfind(_END, 0, k)  # the signature may occur in the comment
        if k < 0:
            raise ValueError("no end of central directory")
        count, length, at = struct.unpack_from("<HII", tail, k + 10)
        if k >= 20 and tail[k - 20 : k - 16] == _LOCATOR:
            end64 = self.read(struct.unpack_from("<Q", tail, k - 12)[0], 56)
            if end64[:4] != _END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, at = struct.unpack_from("<QQQ", end64, 32)
        directory, k = self.read(at, length), 0
        for _ in range(count):
            if directory[k : k + 4] != _ENTRY:
                raise ValueError("bad central directory")
            method, packed, full, n_name, n_extra, n_comment = (*struct.unpack_from("<H", directory, k + 10), *struct.unpack_from("<II", directory, k + 20), *struct.unpack_from("<HHH", directory, k + 28))
            start = struct.unpack_from("<I", directory, k + 42)[0]
            name = directory[k + 46 : k + 46 + n_name].decode()
            extra, e = directory[k + 46 + n_name : k + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # ZIP64: only the fields that are full in the entry, in this order
                    p = e + 4
                    values = [full, packed, start]
                    for i, v in enumerate(values):
                        if v == 0xFFFFFFFF:
                            values[i] = struct.unpack_from("<Q", extra, p)[0]
                            p += 8
                    full, packed, start = values
                e += 4 + n
            k += 46 + n_name + n_extra + n_comment
            if method == 0:
                local = self.read(start, 30)
                if local[:4] != _LOCAL:
                    raise ValueError("bad local header")
                yield name, (start + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)

    def records(self) -> Iterator[bytes]:
        """The gzip members of all stored archives in index order; near ranges are read together."""
        for name, (at, _) in self.members.items():
            m = re.fullmatch(r"data/(.+)\.warc\.gz", name)
            if not m:
                continue
            index = self.members.get(f"indexes/{m[1]}.cdxj")
            if index is None:
                raise ValueError(f"no stored index of {name}")
            lines = [json.loads(x) for x in self.read(*index).decode().splitlines()]
            k = 0
            while k < len(lines):
                first, j = lines[k]["offset"], k + 1
                while j < len(lines) and lines[j]["offset"] == lines[j - 1]["offset"] + lines[j - 1]["length"] and lines[j]["offset"] + lines[j]["length"] - first <= READ:
                    j += 1
                block = self.read(at + first, lines[j - 1]["offset"] + lines[j - 1]["length"] - first)
                for x in lines[k:j]:
                    yield block[x["offset"] - first : x["offset"] - first + x["length"]]
                k = j


def _roles(pages: DataFrame) -> DataFrame:
    """at and refers_to of each revisit; pages has at, page_id and payload."""
    digests = materialize(pages.select("at", "page_id", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest")), "payloads", wide=True)
    able = digests.filter(F.col("bytes") >= LEAST)
    hits = Bloom.of_repeated(able, "digest").probe(able, F.col("digest"), "hit").filter("hit").drop("hit")
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "at")).alias("first")
    groups = materialize(hits.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "payload-groups")
    return materialize(hits.join(groups, "digest").filter("at <> first.at").select("at", F.col("first.page_id").alias("refers_to"), F.lit(True).alias("revisit")), "revisits")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes the pages (page_id, url, html) and returns the manifest: path, bytes, records. Only rows that may be revisits
    are shuffled; the second reading finds a page by its file and its place there."""
    small_batches(pages.sparkSession)
    page_id, url, html = (F.col(place(pages, c)) for c in ("page_id", "url", "html"))
    rows = located(pages).select("at", page_id.cast("long").alias("page_id"), url.alias("url"), F.coalesce(html, F.lit("")).cast("binary").alias("payload"))
    revisits = _roles(rows)
    probed = Bloom(revisits.count()).of_keys(revisits, "at").probe(rows, F.col("at"), "hit")
    clear = probed.filter("NOT hit").select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    maybe = probed.filter("hit").join(revisits, "at", "left").select("page_id", "url", "payload", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer = writer or ArchiveWriter(folder)
                writer.add(page_id, record(page_id, url, payload, hashlib.sha256(payload).hexdigest(), len(payload), refers_to, revisit))
                if len(writer.data) >= archive_bytes:
                    done.append(writer.close())
        if writer and writer.index:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], names=["path", "bytes", "records"])

    out = [x.mapInArrow(run, "path string, bytes long, records long") for x in (clear, maybe)]
    return materialize(out[0].unionByName(out[1]), "manifest", wide=True)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives that the manifest names; payloads: with url and payload (null: revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] * payloads)]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.string(), pa.binary()] * payloads)]

        def number(header: str | None) -> int | None:
            m = re.fullmatch(r"<urn:page:(-?\d+)>", header or "")
            return int(m[1]) if m else None

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with fs.open_input_file(f"{root}/{path}") as f:
                    for member in ArchiveReader(f).records():
                        headers, payload, size = parse(member)
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: a payload doesn't match its digest")
                        rows.append((number(headers["WARC-Record-ID"]), size, digest, kind, number(headers.get("WARC-Refers-To")), *((headers.get("WARC-Target-URI"), payload if kind == "response" else None) if payloads else ())))
                        held += len(payload) * payloads + 200
                        if held > READ:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    total = manifest.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-(total[1] or 0) // SHARE))
    return manifest.select("path").repartition(max(1, min(tasks, total[0]))).mapInArrow(run, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(read(spark, sf_dir, "pages"), folder), folder)


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN first END AS refers_to FROM f
"""
