"""WARC records in ZIP packages: writing, and reading by byte ranges without extraction.

A package holds a stored member ``archive/data.warc.gz`` (every record a gzip member of its own) and a stored index
``indexes/index.cdxj`` (a line of JSON for each record: where it is in the member).  The reader fetches the end of the
package, parses the end-of-central-directory record and, where there is one, the ZIP64 record, then the central directory
(with ZIP64 extra fields), locates the members' data behind their local headers, reads the index and then only the byte
ranges of the records asked for.

Packages are written by tasks under names of their own attempt into the shared folder; only those in the manifest, a table
that Spark commits, count, so retried or doubled tasks leave nothing in the result.  Files are opened through Arrow's file
systems; the folder's full URI is Hadoop's, so a path without a scheme is where Spark's own tables would be.

Payloads are compressed slice by slice into the package and fetched record by record, so memory is bounded by a few copies
of the longest payload.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, scratch_path

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads below this size are never revisits.
LEAST_REVISIT_BYTES = 100
#: Characters of payload and records of one package, about.
PACKAGE_CHARS = 16_000_000
PACKAGE_RECORDS = 4_000
#: Neighbouring records are fetched together up to this many bytes.
FETCH_BYTES = 1 << 20
#: Characters of a payload that are encoded at a time, and payload bytes of one batch of records read.
SLICE_CHARS = 1 << 18
BATCH_BYTES = 1 << 24

# ---- fixed values of the ZIP format ------------------------------------------------------------------------------------
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 0x0001


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark itself would use for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


# ---- reading -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    header: int


class ZipPackage:
    """Directory of a ZIP file and byte ranges of its stored members; ``source`` has ``size()``, ``seek`` and ``read``."""

    def __init__(self, source):
        self.source = source
        self.members = {m.name: m for m in self._directory()}

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError(f"the file ends within {n} bytes at {at}")
        return data

    def _directory(self) -> Iterator[Member]:
        size = self.source.size()
        tail_at = max(0, size - 22 - FULL16)
        tail = self._read(tail_at, size - tail_at)
        at = len(tail)
        while True:  # a comment may hold the signature by chance: the record must end the file
            at = tail.rfind(EOCD, 0, at)
            if at < 0:
                raise ValueError("not a ZIP file: no end of central directory")
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
        entries, length, start = struct.unpack_from("<HII", tail, at + 10)
        directory_end = tail_at + at
        locator = self._read(directory_end - 20, 20) if directory_end >= 20 else b""
        if locator[:4] == LOCATOR64:  # some writers add the ZIP64 record although the 32-bit fields suffice
            (where,) = struct.unpack_from("<Q", locator, 8)
            candidates = (where, directory_end - 76)  # the second: bytes stand before the package
            where = next((x for x in candidates if 0 <= x <= size - 56 and self._read(x, 4) == EOCD64), None)
            if where is None:
                raise ValueError("the ZIP64 locator points at no ZIP64 record")
            entries, length, start = struct.unpack_from("<QQQ", self._read(where, 56), 32)
            directory_end = where
        elif entries == FULL16 or FULL32 in (length, start):
            raise ValueError("the ZIP64 locator is missing")
        shift = directory_end - length - start  # bytes before the package, as in self-extracting files
        data, at = self._read(start + shift, length), 0
        for _ in range(entries):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("damaged central directory")
            flags, method, _, _, crc, packed, full, n, m, k, _, _, _, header = struct.unpack_from("<HHHHIIIHHHHHII", data, at + 8)
            name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + n : at + 46 + n + m]
            while len(extra) >= 4:
                kind, size = struct.unpack_from("<HH", extra)
                if kind == EXTRA64:
                    wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, 4))
                    full = next(wide) if full == FULL32 else full
                    packed = next(wide) if packed == FULL32 else packed
                    header = next(wide) if header == FULL32 else header
                extra = extra[4 + size :]
            yield Member(name, method, flags, crc, packed, full, header + shift)
            at += 46 + n + m + k

    def data_start(self, name: str) -> int:
        """Where a stored member's bytes begin in the file."""
        member = self.members[name]
        if member.method or member.flags & 1:
            raise ValueError(f"{name} is compressed or encrypted; only stored members can be read by range")
        head = self._read(member.header, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        n, m = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + n + m

    def read_range(self, name: str, offset: int, length: int) -> bytes:
        member = self.members[name]
        if offset < 0 or offset + length > member.size:
            raise ValueError(f"{length} bytes at {offset} are not in {name}")
        return self._read(self.data_start(name) + offset, length)

    def read_member(self, name: str) -> bytes:
        data = self.read_range(name, 0, self.members[name].size)
        if zlib.crc32(data) != self.members[name].crc:
            raise ValueError(f"{name} is damaged")
        return data


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of an uncompressed WARC record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, body


class WarcPackage:
    """Records of a package by their index."""

    def __init__(self, source):
        self.zip = ZipPackage(source)
        self.index = [json.loads(x.split(b" ", 2)[2]) for x in self.zip.read_member(INDEX_MEMBER).splitlines() if x]
        self.start = self.zip.data_start(DATA_MEMBER)

    def record(self, entry: dict) -> tuple[dict[str, str], bytes]:
        return parse_record(gzip.decompress(self.zip.read_range(DATA_MEMBER, entry["offset"], entry["length"])))

    def records(self, first: int = 0, count: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
        """Records in the order of the index; neighbours in the file are fetched by one range."""
        entries = self.index[first : None if count is None else first + count]
        k = 0
        while k < len(entries):
            a, end, stop = entries[k]["offset"], entries[k]["offset"] + entries[k]["length"], k + 1
            while stop < len(entries) and entries[stop]["offset"] == end and end + entries[stop]["length"] - a <= FETCH_BYTES:
                end += entries[stop]["length"]
                stop += 1
            data = self.zip.read_range(DATA_MEMBER, a, end - a)
            for e in entries[k:stop]:
                yield parse_record(gzip.decompress(data[e["offset"] - a : e["offset"] - a + e["length"]]))
            k = stop


# ---- writing -----------------------------------------------------------------------------------------------------------


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_chunks(row: dict) -> Iterator[bytes]:
    """A response record with its payload, or a revisit record that names the response it repeats.

    ``payload_bytes`` and ``payload_digest`` of the row, where it has them, are not computed again.
    """
    html = row["html"] or ""
    size, digest = row.get("payload_bytes"), row.get("payload_digest")
    if size is None or digest is None:
        payload = html.encode("utf-8")
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": _urn(row["page_id"]),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": "" if row["page_id"] is None else str(row["page_id"]),
    }
    if revisit:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(row["refers_to"]), "X-Refers-To-Page-ID": str(row["refers_to"])}
    headers["Content-Length"] = str(len(http) + (0 if revisit else size))
    yield b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode("utf-8") + b"\r\n" + http
    if not revisit:
        for at in range(0, len(html), SLICE_CHARS):
            yield html[at : at + SLICE_CHARS].encode("utf-8")
    yield b"\r\n\r\n"


def gzip_member(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The chunks as one gzip member."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    for chunk in chunks:
        packed = packer.compress(chunk)
        if packed:
            yield packed
    yield packer.flush()


class ZipWriter:
    """Writes stored members one after another to a stream that only goes forward, always with ZIP64 fields."""

    def __init__(self, out):
        self.out, self.at, self.directory = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, chunks) -> int:
        """A stored member of unknown size: sizes follow its data (flag 8), as 64-bit numbers; returns its size."""
        raw, header = name.encode("utf-8"), self.at
        extra = struct.pack("<HHQQ", EXTRA64, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x808, 0, 0, 33, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)
        crc = size = 0
        for chunk in chunks:
            self._put(chunk)
            crc, size = zlib.crc32(chunk, crc), size + len(chunk)
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", crc, size, size))
        self.directory.append((raw, crc, size, header))
        return size

    def close(self) -> None:
        start = self.at
        for raw, crc, size, header in self.directory:
            extra = struct.pack("<HHQQQ", EXTRA64, 24, size, size, header)
            fields = struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x808, 0, 0, 33, crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32)
            self._put(CENTRAL + fields + raw + extra)
        length, where, n = self.at - start, self.at, len(self.directory)
        self._put(EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start))
        self._put(LOCATOR64 + struct.pack("<IQI", 0, where, 1))
        self._put(EOCD + struct.pack("<HHHHIIH", FULL16, FULL16, FULL16, FULL16, FULL32, FULL32, 0))


def write_package(out, rows: Iterator[dict]) -> int:
    """Writes one package and returns the number of its records."""
    lines, at = [], 0

    def members() -> Iterator[bytes]:
        nonlocal at
        for row in rows:
            first = at
            for packed in gzip_member(record_chunks(row)):
                at += len(packed)
                yield packed
            entry = {"offset": first, "length": at - first, "mime": "warc/revisit" if row["record_type"] == "revisit" else "text/html", "url": row["url"]}
            key = "".join((row["url"] or "-").split()) or "-"
            lines.append(f"{key} 19700101000000 {json.dumps(entry)}".encode())

    writer = ZipWriter(out)
    writer.add(DATA_MEMBER, members())
    writer.add(INDEX_MEMBER, [b"\n".join(lines) + b"\n"])
    writer.close()
    return len(lines)


# ---- tables ------------------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, record_type, refers_to``: which pages repeat the payload of one
    with a smaller id.

    Only digests are grouped.  Those that more than one id has are a table, which Spark broadcasts if it is small; beyond its
    limit every payload moves once, to join it, and adaptive execution splits the hot digests.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select("page_id", "url", "html", F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    small = F.col("payload_bytes") < least_bytes
    # small payloads get a key of their own row's making (of another length), so they meet nothing and no partition is hot
    alone = F.unhex(F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), F.monotonically_increasing_id().cast("string"))))
    keyed = sized.withColumn("_digest", F.when(small, alone).otherwise(F.unhex("payload_digest")))
    first = sized.where(~small).groupBy(F.unhex("payload_digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("n"))
    repeated = materialize(first.where((F.col("n") > 1) & F.col("_first").isNotNull()).select("_digest", "_first"), "repeated")
    joined = keyed.join(repeated, "_digest", "left")
    revisits = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("_first")).alias("refers_to")
    )


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of ``pages`` into ZIP packages under ``folder``; returns the manifest ``path, records``.

    Each task fills packages of a bounded size one after another.
    """
    folder = qualified(pages.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows))
        ahead = next(rows, None)
        done = []
        while ahead is not None:
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            system, name = open_path(path)
            system.create_dir(name.rsplit("/", 1)[0], recursive=True)

            def package() -> Iterator[dict]:
                nonlocal ahead
                chars = count = 0
                while ahead is not None and chars < PACKAGE_CHARS and count < PACKAGE_RECORDS:
                    yield ahead
                    chars, count = chars + len(ahead["html"] or ""), count + 1
                    ahead = next(rows, None)

            with system.open_output_stream(name) as out:
                done.append((path, write_package(out, package())))
        yield pa.record_batch([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    columns = pages.select("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return materialize(columns.mapInArrow(write, "path string, records bigint"), "manifest")


_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
_RECORD_DDL = "page_id bigint, url string, payload string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _row(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(headers[name]) if headers.get(name) else None
    http, payload = split_http(block)
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    if headers["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of page {headers.get('x-page-id')} does not have its digest")
    body = payload.decode("utf-8") if headers["warc-type"] == "response" else None
    return number("x-page-id"), headers["warc-target-uri"], body, int(http["content-length"]), digest, headers["warc-type"], number("x-refers-to-page-id")


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Record batches of a bounded number of payload bytes."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else ([] for _ in _RECORD)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _RECORD, strict=True)], schema=_RECORD)

    for row in rows:
        held.append(row)
        size += row[3]
        if size >= BATCH_BYTES:
            yield flush()
            held, size = [], 0
    yield flush()


def read_packages(manifest: DataFrame, slice_records: int = 1000) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of every record of the packages.

    Slices of the packages' indexes are dealt to a number of tasks that is fixed beforehand (adaptive execution would put
    all slices, which are rows of some bytes, into one task): a task for each slice, up to eight for each core.  A task reads
    its slices' part of the index and then only the ranges of their records.  A response's digest is checked; a revisit
    record has no payload of its own (null), its size and digest are those of the full payload (see
    :func:`broken_revisits`).
    """
    spark = manifest.sparkSession
    slices = manifest.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("records") - 1, F.lit(0)), F.lit(slice_records))).alias("first"))
    number = manifest.agg(F.sum(F.ceil(F.greatest(F.col("records"), F.lit(1)) / slice_records)).alias("n")).first()["n"] or 1
    tasks = int(max(1, min(number, 8 * spark.sparkContext.defaultParallelism)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                system, name = open_path(piece["path"])
                with system.open_input_file(name) as source:
                    yield from _batches(_row(*r) for r in WarcPackage(source).records(piece["first"], slice_records))

    return slices.repartition(tasks, "path", "first").mapInArrow(read, _RECORD_DDL)


def broken_revisits(records: DataFrame) -> DataFrame:
    """Revisit records (``page_id, refers_to``) whose response is missing or has another size or digest."""
    own = records.where("record_type = 'revisit'").select("page_id", "refers_to", F.col("payload_bytes").alias("_n"), F.col("payload_digest").alias("_d"))
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_n"), F.col("payload_digest").alias("_d")).distinct()
    return own.join(responses, ["refers_to", "_n", "_d"], "left_anti").select("page_id", "refers_to")


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` to packages and returns the records read back from them.

    Nulls: a null ``html`` is an empty payload, a null ``url`` an empty target; a null ``page_id`` stays null, and such a
    row revisits the least id of an equal payload (with no such id it is a response).  Ties: rows that repeat the least id
    with an equal payload are all responses.  A payload of any length is a record of its own.  An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    folder = folder or scratch_path(pages.sparkSession, "packages")
    return read_packages(write_packages(with_revisits(pages), folder))
