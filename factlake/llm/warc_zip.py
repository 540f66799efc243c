"""WARC archives packaged in ZIP: written by tasks, read by range.

Package: a ZIP file (ZIP64 where it needs it) whose members are stored, not
compressed: ``archive/data.warc.gz`` (every record a gzip member of its own)
and ``indexes/index.cdxj`` (one JSON line per record: page, offset, length).
The reader finds the end-of-directory record, follows the ZIP64 locator if
there is one, parses the central directory, and from then on reads ranges:
the index, and each record by its offset inside the stored archive member.
Nothing is extracted and no member is read whole but the index.

Of records with equal payloads of at least ``MIN_BYTES`` bytes the one with the
largest page_id holds the payload (response); the others are revisit records
that name it. Digests are counted with map-side combining; a payload that a
third of all pages share skews neither join (``heavy_join``), and the pages
meet their verdicts by a key of their own.

Defined cases: a null html is an empty payload; a null page_id sorts below all
others and is no target (equal payloads of null ids only are all responses);
rows that repeat the largest page_id of their payload are all responses; a
null url has no target header; extra columns are ignored; an empty table
writes no package and gives no rows. A package is closed and the next begun
after ``PACKAGE_BYTES`` or ``PACKAGE_RECORDS``; a task reads or writes one at a time.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, open_store, prepare, shared_folder, written

MIN_BYTES = 1000
PACKAGE_BYTES = 256 << 20
PACKAGE_RECORDS = 100_000

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- records ----------------------------------------------------------------

def _page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none-' + uuid.uuid4().hex if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_page_urn(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        clean = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
        head.append(f"WARC-Target-URI: {clean}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_page_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse_record(raw: bytes) -> dict:
    """Type, page ids, payload length and digest of one record; a response's
    digest is worked out from its payload, a revisit has that of its header."""
    import hashlib

    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload that does not match its digest")

    def page(urn: str) -> int | None:
        name = urn.strip("<>").removeprefix("urn:page:")
        return None if name.startswith("none-") else int(name)

    return {"page_id": page(h["warc-record-id"]), "payload_bytes": int(_headers(http)["content-length"]),
            "payload_digest": digest, "record_type": h["warc-type"],
            "refers_to": page(h["warc-refers-to"]) if "warc-refers-to" in h else None,
            "url": h.get("warc-target-uri"), "payload": payload}


# ---- packages ---------------------------------------------------------------

class PackageWriter:
    """One package: records go to the archive member as they come, the index
    member follows at the end."""

    def __init__(self, sink):
        self.sink = sink
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.lines: list[str] = []
        self.offset = 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        raw = record(page_id, url, payload, digest, refers_to)
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = squeeze.compress(raw) + squeeze.flush()
        self.member.write(packed)
        self.lines.append(json.dumps({"page": page_id, "offset": self.offset, "length": len(packed)}))
        self.offset += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.sink.close()


class PackageReader:
    """Members of a ZIP file by range: central directory, ZIP64, stored data."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail_at = max(0, size - 22 - 65535)
        tail = self.range(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of a central directory")
        count, length, start = struct.unpack_from("<10xHII", tail, end)
        if end >= 20 and tail[end - 20: end - 16] == b"PK\x06\x07":
            (at,) = struct.unpack_from("<8xQ", tail, end - 20)
            raw = self.range(at, 56)
            if raw[:4] != b"PK\x06\x06":
                raise ValueError("a ZIP64 locator that leads nowhere")
            count, length, start = struct.unpack_from("<32xQQQ", raw)
        self.members: dict[str, tuple[int, int, int]] = {}  # name: method, length, offset of the local header
        raw, at = self.range(start, length), 0
        for _ in range(count):
            mark, flags, method, packed, whole, n, m, k, offset = struct.unpack_from("<4s4xHH8xIIHHH8xI", raw, at)
            if mark != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            name = raw[at + 46: at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = raw[at + 46 + n: at + 46 + n + m], 0
            while e + 4 <= len(extra):
                kind, span = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # ZIP64: those of the fields that did not fit, in this order
                    wide = iter(struct.unpack_from(f"<{span // 8}Q", extra, e + 4))
                    whole = next(wide) if whole == 0xFFFFFFFF else whole
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                e += 4 + span
            self.members[name] = method, packed, offset
            at += 46 + n + m + k

    def range(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def stored(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes within the package."""
        method, length, at = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed: its records cannot be read by range")
        mark, n, m = struct.unpack_from("<4s22xHH", self.range(at, 30))
        if mark != b"PK\x03\x04":
            raise ValueError("a central directory entry that leads nowhere")
        return at + 30 + n + m, length

    def records(self) -> Iterator[dict]:
        """Every record that the index lists, each by a range of its own."""
        begin, _ = self.stored(ARCHIVE)
        at, length = self.stored(INDEX)
        for line in self.range(at, length).decode().splitlines():
            entry = json.loads(line)
            yield parse_record(zlib.decompress(self.range(begin + entry["offset"], entry["length"]), 31))


# ---- the Spark jobs ---------------------------------------------------------

def _row_key(id_col: str) -> list:
    return [F.xxhash64(id_col, "_digest").alias("_r1"), F.xxhash64(F.lit(7), F.col("_digest"), F.col(id_col)).alias("_r2")]


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(_r1, _r2, _refers) for the rows of ``pages`` (_id, _digest, _bytes) whose
    payload a row with a larger page_id has too."""
    large = pages.where(F.col("_bytes") >= min_bytes).select("_id", "_digest")
    winners = large.groupBy("_digest").agg(F.max("_id").alias("_refers"), F.count(F.lit(1)).alias("_w")).where("_w > 1")
    hits = heavy_join(large, winners, ["_digest"], "_w", F.xxhash64("_id"), how="inner")
    return hits.where("_refers is not null and not _id <=> _refers").select(*_row_key("_id"), "_refers").distinct()


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write every row as a record into packages below ``folder``, which all
    executors share. Returns the manifest (path, n_records), a written table:
    only packages of tasks that finished are in it."""
    prepare(pages.sparkSession)
    slim = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    slim = slim.withColumn("_digest", F.sha1("_html"))
    gone = revisits(slim.select("_id", "_digest", F.octet_length("_html").alias("_bytes")), min_bytes)
    r1, r2 = _row_key("_id")
    ready = slim.withColumn("_r1", r1).withColumn("_r2", r2).join(gone, ["_r1", "_r2"], "left").select(
        "_id", "_url", "_html", "_digest", "_refers")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        package = path = None
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, url, html, digest, refers = (x.as_py() for x in row)
                if package is None:
                    store.create_dir(base, recursive=True)
                    path = f"pages-{uuid.uuid4().hex}.wacz"
                    package = PackageWriter(store.open_output_stream(f"{base}/{path}"))
                package.add(page_id, url, html.encode("utf-8", "replace"), digest, refers)
                if package.offset >= PACKAGE_BYTES or len(package.lines) >= PACKAGE_RECORDS:
                    package.close()
                    done.append((path, len(package.lines)))
                    package = None
        if package is not None:
            package.close()
            done.append((path, len(package.lines)))
        yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{p}" for p, _ in done], pa.string()),
                                          "n_records": pa.array([n for _, n in done], pa.int64())})

    return written(ready.mapInArrow(write, "path string, n_records long"), "packages")


def _batches(records: Iterator[dict], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The named fields of the records. A payload that is not among them goes with its record."""
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for r in records:
        rows.append(tuple(r[n] for n in names))
        held += len(r["payload"]) if "payload" in names else 0
        if len(rows) >= 2000 or held > 8 << 20:
            yield batch()
            rows, held = [], 0
    yield batch()


def read_packages(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the packages; with ``payloads`` also the payload itself
    (empty for a revisit)."""
    prepare(manifest.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    if payloads:
        names, types = [*names, "payload"], [*types, pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = open_store(path)
                with store.open_input_file(at) as source:
                    yield from _batches(PackageReader(source).records(), names, types)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInArrow(read, schema + ", payload binary" * payloads)


def archive(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the packages into the shared folder and read every record back."""
    return read_packages(write_packages(pages, shared_folder(pages.sparkSession, "warc"), min_bytes=min_bytes))
