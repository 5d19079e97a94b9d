import hashlib
import io
import struct
import zipfile

import pytest

from eventloom.llm import warc as W


class Ranges(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_directory_zip64_and_comments():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\5\6 a comment with a signature"
        with z.open("data/a.warc.gz", "w", force_zip64=True) as f:
            f.write(b"stored bytes")
        z.writestr(zipfile.ZipInfo("other"), b"x")
        z.writestr("deflated", b"y" * 100, zipfile.ZIP_DEFLATED)
    r = W.ArchiveReader(Ranges(out.getvalue()))
    assert r.read(*r.members["data/a.warc.gz"]) == b"stored bytes" and r.read(*r.members["other"]) == b"x" and "deflated" not in r.members
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(66_000):  # more than the short end record counts
            z.writestr(zipfile.ZipInfo(str(i)), b"")
    assert len(W.ArchiveReader(Ranges(many.getvalue())).members) == 66_000
    with pytest.raises(ValueError):
        W.ArchiveReader(Ranges(b"no archive"))


def test_zip64_offsets_in_the_entry():
    name, data = b"data/b.warc.gz", b"hello"
    local = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, 5, 5)
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 3)
    entry = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    body = b"pad" + local + data
    at = len(body)
    end64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    end = b"PK\6\7" + struct.pack("<IQI", 0, at + len(entry), 1) + b"PK\5\6" + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    r = W.ArchiveReader(Ranges(body + entry + end64 + end))
    assert r.read(*r.members["data/b.warc.gz"]) == b"hello"


def test_round_trip(spark, tmp_path):
    same, short = "<p>é" + "x" * 200, "tiny"
    rows = [(5, "http://a/\r\nX: y", same), (3, "http://b", same), (9, None, same), (9, None, same), (1, "u", short), (2, "u", short), (4, "u", None), (6, "u", ""), (None, "u", same), (7, "u", "\r\n\r\n" * 50_000), (8, "u", "WARC/1.1\r\n\r\n😀" * 30)]
    spark.createDataFrame([(*r, True, 1) for r in rows], "page_id long, url string, html string, revisit boolean, row int").write.parquet(str(tmp_path / "p"))
    folder = f"file://{tmp_path}/warc"
    manifest = W.write_archives(spark.read.parquet(str(tmp_path / "p")), folder, archive_bytes=300)
    assert manifest.count() > 2 and sum(r.records for r in manifest.collect()) == len(rows)
    got = W.read_archives(manifest, folder, payloads=True).collect()
    want = []
    for key, _, html in rows:
        data = (html or "").encode()
        revisit = html == same and key != 3
        want.append((str(key), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert sorted(map(str, want)) == sorted(str((str(r[0]), *r[1:5])) for r in got)
    assert {r.page_id: r.payload for r in got if r.record_type == "response"}[7] == b"\r\n\r\n" * 50_000
    assert next(r.url for r in got if r.page_id == 5) == "http://a/%0D%0AX:%20y"


def test_repeated_page_id_and_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "u", "y" * 150)] * 3, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    folder = f"file://{tmp_path}/w"
    got = W.read_archives(W.write_archives(pages, folder), folder).collect()
    assert sorted(((r.record_type, r.refers_to) for r in got), key=str) == [("response", None), ("revisit", 1), ("revisit", 1)]
    assert W.read_archives(W.write_archives(pages.limit(0), folder), folder).count() == 0
