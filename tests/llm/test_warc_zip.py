import hashlib
import io
import struct
import zipfile

import pytest

from factlake.llm import warc_zip

PAGES = "page_id long, url string, html string, record_type string, _digest int"


def test_reader_follows_zip64():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for i in range(66_000):  # more members than the short directory can count
            z.writestr(f"m{i}", b"%d" % i)
    sink.size = lambda: len(sink.getvalue())
    r = warc_zip.PackageReader(sink)
    assert len(r.members) == 66_000 and b"PK\x06\x06" in sink.getvalue()
    at, n = r.stored("m65999")
    assert r.range(at, n) == b"65999"


def test_reader_takes_wide_offsets_and_refuses_compressed_members():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    raw = bytearray(sink.getvalue())
    at = raw.rfind(b"PK\x01\x02")  # move sizes and offset of the entry into a ZIP64 field
    n = struct.unpack_from("<H", raw, at + 28)[0]
    wide = struct.pack("<HHQQQ", 1, 24, 100, struct.unpack_from("<I", raw, at + 20)[0], 0)
    struct.pack_into("<II", raw, at + 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<H", raw, at + 30, len(wide))
    struct.pack_into("<I", raw, at + 42, 0xFFFFFFFF)
    raw[at + 46 + n: at + 46 + n] = wide
    end = raw.rfind(b"PK\x05\x06")
    struct.pack_into("<I", raw, end + 12, end - at)
    source = io.BytesIO(raw)
    source.size = lambda: len(raw)
    r = warc_zip.PackageReader(source)
    assert r.members["a"][2] == 0
    with pytest.raises(ValueError, match="compressed"):
        r.stored("a")


def test_records_and_revisits(spark):
    big, tie = "<p>" + "x" * 2000, "y" * 1000
    rows = [(1, "http://a/1", big), (5, "http://a/\r\n5", big), (9, None, big), (2, "u", "small"), (3, "u", "small"), (4, "u", None),
            (None, "u", big), (7, "t", tie), (7, "t2", tie), (8, "é", "ü" * 600), (None, "n", "z" * 1500), (None, "n", "z" * 1500)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_zip.archive(df).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        top = max((j for j, _, h in rows if (h or "").encode() == raw and j is not None), default=None) if len(raw) >= 1000 else None
        again = top is not None and top != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=str)
    assert warc_zip.archive(df.limit(0)).count() == 0


def test_packages_hold_the_payloads(spark, scratch, monkeypatch):
    df = spark.createDataFrame([(i, f"u{i}", f"<p>page {i % 20} " + "w" * 1200, "", 0) for i in range(50)], PAGES)
    manifest = warc_zip.write_packages(df, scratch)
    back = {r.page_id: r for r in warc_zip.read_packages(manifest, payloads=True).collect()}
    for r in df.collect():
        own = back[r.page_id]
        full = own if own.record_type == "response" else back[own.refers_to]
        assert bytes(full.payload).decode() == r.html and own.payload_bytes == len(r.html)
    path = manifest.first().path
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and set(z.namelist()) == {warc_zip.ARCHIVE, warc_zip.INDEX}


def test_reading_without_payloads_holds_none():
    import tracemalloc

    import pyarrow as pa

    from factlake.llm.warc_zip import _batches

    def records():
        for i in range(200):
            yield {"page_id": i, "payload": bytes(1 << 20)}

    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in _batches(records(), ["page_id"], [pa.int64()]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 200 and peak < 8 << 20
    both = list(_batches(records(), ["page_id", "payload"], [pa.int64(), pa.binary()]))
    assert len(both) > 10 and sum(b.num_rows for b in both) == 200
