"""Web archives in ZIP packages: writing them, and reading records by range.

A package is a ZIP file of stored members: ``archive/data.warc.gz`` (a gzip member for each
record), ``indexes/index.cdxj`` (a line for each record: where it lies) and
``datapackage.json``.  Members are stored without compression of their own, so a record lies at
a known place of the package.  The reader finds the central directory from the file's end (ZIP64
records where there are any), the data members and their indexes from the directory, and then
reads the records' byte ranges, neighbours in one go; nothing is unpacked.

Packages are written below the shared folder under a name of their task's attempt; only the
packages of attempts that Spark commits are in the list that is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import suppress
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import scratch, slices, stage

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MIN_BYTES = 0
#: A task goes on to a new package when one has so many bytes; a reader's part of a package.
PACKAGE_BYTES = 1 << 30
PART_BYTES = 32 << 20
#: Neighbouring records are read together up to so many bytes.
READ_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """A WARC record as a gzip member, and its payload's digest.  A revisit has the headers of the response only."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    sha = digest(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#%[]!*()~') if url else 'about:blank'}",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http;msgtype=response",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    block = _HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    head.append(f"Content-Length: {len(block)}")
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush(), sha


class _Sink:
    """What zipfile needs of a stream that can't seek."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def write(self, data) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass

    def tell(self) -> int:
        return self.at


class Package:
    """Writes one package, record by record."""

    def __init__(self, stream):
        self.stream, self.lines, self.bytes = stream, [], 0
        self.zip = zipfile.ZipFile(_Sink(stream), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)

    def add(self, url: str | None, member: bytes, sha: str, kind: str) -> None:
        self.data.write(member)
        self.lines.append(json.dumps({"url": url, "digest": sha, "type": kind, "offset": self.bytes, "length": len(member), "filename": DATA.split("/")[1]}))
        self.bytes += len(member)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(INDEX, "".join(f"{line}\n" for line in self.lines))
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()
        self.stream.close()


class ZipDirectory:
    """The members of a ZIP file, from its central directory; ``source`` has ``size()`` and ``read_at(n, offset)``."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(min(size, 65557 + 20), max(0, size - 65557 - 20))
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":  # the locator of the ZIP64 record
            (at,) = struct.unpack_from("<Q", tail, end - 12)
            big = source.read_at(56, at)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory where its locator points")
            count, length, start = struct.unpack_from("<QQQ", big, 32)
        self.members = dict(self._entries(source.read_at(length, start), count))

    @staticmethod
    def _entries(raw: bytes, count: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        """Name -> (method, stored size, offset of the local header)."""
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, plain = struct.unpack_from("<II", raw, at + 20)
            names, extras, notes = struct.unpack_from("<HHH", raw, at + 28)
            (offset,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = raw[at + 46 + names : at + 46 + names + extras], 0
            while e + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # ZIP64: only what did not fit, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                e += 4 + n
            yield name, (method, packed, offset)
            at += 46 + names + extras + notes

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        method, size, offset = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored: it can't be read by range")
        head = self.source.read_at(30, offset)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        names, extras = struct.unpack_from("<HH", head, 26)
        return offset + 30 + names + extras, size


def parse_record(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of one record; checks a response's digest."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sha, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response":
        size = len(payload)
        if digest(payload) != sha:
            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    else:
        size = next(int(v) for k, _, v in (line.partition(":") for line in http.decode().split("\r\n")) if k.lower() == "content-length")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("page-id"), size, sha, kind, number("refers-to-page-id")


def _open(path: str):
    files, inner = pa.fs.FileSystem.from_uri(path)
    return files, inner


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes all pages; ``path, records, bytes`` of the packages.

    Of records with equal payloads of ``min_bytes`` at least, those of the largest id are
    responses and the others revisits of it; payloads are equal by SHA-256 and length.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= min_bytes, F.sha2(F.col("html").cast("binary"), 256)))
    copies = rows.where("key IS NOT NULL").groupBy("key").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("key", "original")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, package, done = TaskContext.get(), None, []

        def finish():
            package.close()
            done.append((path, len(package.lines), package.bytes))

        for whole in batches:
            for batch in slices(whole, "html"):
                for page_id, url, text, original in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "original")), strict=True):
                    if package is None:
                        path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done)}.wacz"
                        files, inner = _open(path)
                        files.create_dir(inner.rpartition("/")[0], recursive=True)
                        package = Package(files.open_output_stream(inner))
                    revisit = original is not None and page_id != original
                    member, sha = record(page_id, url, text.encode("utf-8", "surrogatepass"), original, revisit)
                    package.add(url, member, sha, "revisit" if revisit else "response")
                    if package.bytes >= PACKAGE_BYTES:
                        finish()
                        package = None
        if package is not None:
            finish()
        columns = zip(*done, strict=True) if done else ([], [], [])
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    # by sort-merge at any size, so that a large group of copies is split and no size decides the plan
    marked = rows.join(copies.hint("merge"), "key", "left").select("page_id", "url", "html", "original")
    return marked.mapInArrow(run, "path string, records long, bytes long")


class _Source:
    def __init__(self, path: str):
        files, inner = _open(path)
        self.file = files.open_input_file(inner)
        self.size = self.file.size

    def read_at(self, n: int, offset: int) -> bytes:
        return self.file.read_at(n, offset)


def index(packages: DataFrame) -> DataFrame:
    """``path, start, length`` of each record, absolute in its package, from the packages' own indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source = _Source(path)
                directory = ZipDirectory(source)
                for name in [n for n in directory.members if n.startswith("indexes/")]:
                    start, size = directory.place(name)
                    left = b""
                    for at in range(start, start + size, READ_BYTES):
                        part = left + source.read_at(min(READ_BYTES, start + size - at), at)
                        *lines, left = part.split(b"\n")
                        found = [json.loads(x) for x in lines if x]
                        homes = {f: directory.place(f"archive/{f}")[0] for f in {x["filename"] for x in found}}
                        yield pa.record_batch(
                            {
                                "path": pa.array([path] * len(found), pa.string()),
                                "start": pa.array([homes[x["filename"]] + x["offset"] for x in found], pa.int64()),
                                "length": pa.array([x["length"] for x in found], pa.int64()),
                            }
                        )
                with suppress(OSError):
                    source.file.close()

    return packages.select("path").mapInArrow(run, "path string, start long, length long")


def read_records(places: DataFrame) -> DataFrame:
    """The records at ``places`` (:func:`index`): one row each, from byte ranges of the packages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = source = None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length")), strict=True))
            out, i = [], 0
            while i < len(rows):
                j, first = i + 1, rows[i][1]
                while j < len(rows) and rows[j][0] == rows[i][0] and rows[j][1] == rows[j - 1][1] + rows[j - 1][2] and rows[j][1] + rows[j][2] - first <= READ_BYTES:
                    j += 1
                if rows[i][0] != path:
                    path = rows[i][0]
                    source = _Source(path)
                data = source.read_at(rows[j - 1][1] + rows[j - 1][2] - first, first)
                out += [parse_record(data[s - first : s - first + n]) for _, s, n in rows[i:j]]
                i = j
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    part = F.floor(F.col("start") / PART_BYTES)
    dealt = places.repartition("path", part).sortWithinPartitions("path", "start")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes all pages to packages in the shared folder and reads every record back.

    One row per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.  A null
    page is the empty payload (and equal to other empty ones); a null url is written as
    ``about:blank``; a null id stays null, comes before all others, and is a response only
    where no copy has an id.  Rows that repeat the largest id of a payload are all responses.
    """
    folder = scratch(pages.sparkSession, "warc")
    packages = stage(write_packages(pages, folder, id_col, url_col, html_col, min_bytes), "packages")
    return read_records(index(packages))
