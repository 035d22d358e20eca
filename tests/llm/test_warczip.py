import hashlib
import io
import struct
import zipfile

import pytest

from millrace.llm import warczip as w


class Source(io.BytesIO):
    """Bytes as a file that counts what is read of it."""

    def __init__(self, data):
        super().__init__(data)
        self.ranges = []

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        self.ranges.append((self.tell(), n))
        return super().read(n)


def _row(k, html="<p>x</p>", kind="response", refers=None, url="http://a.example/"):
    return {"page_id": k, "url": url, "html": html, "record_type": kind, "refers_to": refers}


def _package(rows):
    out = io.BytesIO()
    assert w.write_package(out, iter(rows)) == len(rows)
    return out.getvalue()


def test_a_package_is_a_zip_file_with_stored_members():
    data = _package([_row(1), _row(2, "ü" * 500)])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.namelist() == [w.DATA_MEMBER, w.INDEX_MEMBER]
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        ours = w.ZipPackage(Source(data))
        for name in z.namelist():
            assert ours.read_member(name) == z.read(name)


def test_records_are_read_by_range_only():
    rows = [_row(k, "page %d " % k * 2000) for k in range(200)]
    data = _package(rows)
    source = Source(data)
    package = w.WarcPackage(source)
    before = len(source.ranges)
    headers, block = package.record(package.index[150])
    assert headers["x-page-id"] == "150" and w.split_http(block)[1].decode() == rows[150]["html"]
    fetched = [n for _, n in source.ranges[before:] if n]
    assert max(fetched) == package.index[150]["length"] and sum(fetched) < len(data) / 50
    assert [h["x-page-id"] for h, _ in package.records(20, 5)] == ["20", "21", "22", "23", "24"]
    assert len(list(package.records())) == 200


@pytest.mark.parametrize("wide", [False, True])
def test_packages_of_another_writer(monkeypatch, wide):
    if wide:  # makes the standard library write ZIP64 records for small files
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 5)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO(b"#!/bin/sh\n")
    out.seek(0, 2)
    with zipfile.ZipFile(out, "a" if not wide else "w", zipfile.ZIP_STORED) as z:
        z.writestr("ä/one.txt", b"hello world")
        z.writestr("two.bin", bytes(range(256)) * 4)
        z.comment = b"a comment with PK\x05\x06 in it and more than twenty-two bytes"
    data = out.getvalue()
    assert (w.EOCD64 in data) == wide
    ours = w.ZipPackage(Source(data))
    assert ours.read_member("ä/one.txt") == b"hello world" and ours.read_range("two.bin", 250, 10) == bytes([250, 251, 252, 253, 254, 255, 0, 1, 2, 3])


def test_what_cannot_be_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"a" * 1000)
    with pytest.raises(ValueError, match="only stored"):
        w.ZipPackage(Source(out.getvalue())).read_range("x", 0, 1)
    with pytest.raises(ValueError, match="not a ZIP"):
        w.ZipPackage(Source(b"nothing of the kind" * 10))
    data = bytearray(_package([_row(1)]))
    with pytest.raises(ValueError, match="bytes at"):
        w.ZipPackage(Source(bytes(data))).read_range(w.INDEX_MEMBER, 0, 10**6)
    at = data.index(b"offset")
    data[at : at + 6] = b"OFFSET"
    with pytest.raises(ValueError, match="damaged"):
        w.WarcPackage(Source(bytes(data)))


def test_a_file_of_more_than_four_gigabytes():
    """The directory's 64-bit fields: a sparse source whose member lies beyond 2^32."""
    far = 5 << 30
    name, payload = b"far.txt", b"beyond"
    local = w.LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 33, 0, len(payload), len(payload), len(name), 0) + name + payload
    extra = struct.pack("<HHQ", w.EXTRA64, 8, far)
    central = w.CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 33, 0, len(payload), len(payload), len(name), len(extra), 0, 0, 0, 0, w.FULL32) + name + extra
    start = far + len(local)
    end = w.EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), start) + w.LOCATOR64 + struct.pack("<IQI", 0, start + len(central), 1)
    end += w.EOCD + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), w.FULL32, 0)
    tail = local + central + end

    class Sparse:
        at = 0

        def size(self):
            return far + len(tail)

        def seek(self, at):
            self.at = at

        def read(self, n):
            zeros = max(0, min(n, far - self.at))
            a = max(0, self.at - far)
            return b"\0" * zeros + tail[a : a + n - zeros]

    assert w.ZipPackage(Sparse()).read_range("far.txt", 0, 6) == payload


def test_pages_round_trip(spark, tmp_path):
    big = "x" * 99 + "é"
    rows = [(5, "http://a/", big), (3, "http://b/", big), (9, None, big), (1, "http://c/", "x" * 99), (2, "u v", "x" * 99), (4, "d", None), (6, "e", ""), (None, "f", big), (3, "http://b/", big), (7, "g", "long " * 200_000), (8, "h", "a\r\n\r\nb" * 30)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, record_type string")
    out = w.archive_and_read(df, f"file://{tmp_path}/packages").collect()
    assert len(out) == len(rows) and len(list((tmp_path / "packages").iterdir())) >= 1
    text = {r[0]: r[2] or "" for r in rows}
    for r in out:
        payload = text[r.page_id].encode()
        revisit = text[r.page_id] == big and r.page_id != 3
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert r.payload == (None if revisit else text[r.page_id])
    assert w.archive_and_read(df.limit(0)).count() == 0
    assert w.broken_revisits(w.archive_and_read(df)).count() == 0
    small = w.read_packages(w.write_packages(w.with_revisits(df), f"file://{tmp_path}/again"), 2)
    assert small.count() == len(rows)


def test_reading_is_dealt_to_many_tasks_and_paths_are_those_of_spark(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.range(900).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.concat(F.lit("page "), "id").alias("html"))
    manifest = w.write_packages(w.with_revisits(df), f"{tmp_path}/plain")
    assert all(r.path.startswith("file:") for r in manifest.collect()) and list((tmp_path / "plain").iterdir())
    read = w.read_packages(manifest, 10)
    assert read.groupBy(F.spark_partition_id()).count().count() > 8 and read.count() == 900
    broken = read.withColumn("record_type", F.when(F.col("page_id") < 2, "revisit").otherwise("response")).withColumn("refers_to", F.lit(5))
    assert sorted(r.page_id for r in w.broken_revisits(broken).collect()) == [0, 1]


def test_a_long_payload_is_compressed_in_slices():
    import tracemalloc

    row = _row(1, "<p>é a long page</p>\n" * 2_000_000)
    tracemalloc.start()
    data = _package([row])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * len(row["html"].encode())
    headers, block = w.WarcPackage(Source(data)).record(w.WarcPackage(Source(data)).index[0])
    assert w.split_http(block)[1].decode() == row["html"]
