"""Suffix-array dedup: bytes covered by a string that also starts elsewhere go.

Every text is a string of bytes. A byte is removed if a string of ``LENGTH`` bytes
that covers it occurs a second time, anywhere; matches do not cross texts, and
strings are judged on the input.

Equal strings have to meet. Each window of ``LENGTH`` bytes is keyed by the smallest
hash of the ``GRAM``-byte strings in it, so equal windows have equal keys; windows
that follow each other with one key form a segment, a stretch of the text. A key
of one segment only, in the whole corpus, that the segment meets only once has
no repeats and goes no further.
Equal segments (128 bits of hash) are merged and counted where they are made,
before any shuffle: a segment found twice is a repeat throughout. What is left,
segments that share a key but differ, is dealt by key into shards, and every
shard is sorted by external induced sorting (``induced_sort``): suffix tuples with
their common-prefix values go through disk-backed priority queues, so a shard
may be far larger than a worker's memory. Neighbours in the order that share
``LENGTH`` bytes are repeats. Repeats become spans of their texts again.
A key that more than ``CROWD`` different segments share is that of a passage with as many
surroundings, and would be one large shard: its windows are keyed by all their
bytes (128 bits) instead and counted, which deals them out over all tasks.

Texts are shuffled twice, compressed: to the segments that are sorted, and to the
spans that are cut. No join is skewed by a segment that a third of the texts
have (``heavy_join``).

Defined cases: a null or empty text has no bytes; rows that repeat an id and text
are texts of their own and so repeat each other; a repeat inside one text counts;
removed runs that touch are one; extra columns are ignored.
"""

from __future__ import annotations

import functools
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import induced_sort
from .common import heavy_join, prepare, written

LENGTH = 200
GRAM = 64
#: Different segments of a key beyond which their windows are compared one by one.
CROWD = 1024
#: Windows handled at a time: bounds the memory of a very long text.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each string of ``gram`` bytes."""
    n = len(raw)
    up, down = _powers(1 << max(12, int(n + 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding(best, values: np.ndarray, span: int) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of each ``span`` values in a row."""
    width = 1
    while 2 * width <= span:
        values = best(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def segments_of(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (first window, windows, key, twice) of a text's segments.
    ``twice``: the segment may meet its smallest string twice, and so hold a
    repeat of its own (it may be set where there is none)."""
    span = length - gram + 1
    for at in range(0, max(0, len(raw) - length + 1), BLOCK):
        h = gram_hashes(np.frombuffer(raw, np.uint8, min(BLOCK + length - 1, len(raw) - at), at), gram)
        keys = sliding(np.minimum, h, span)
        first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        n = np.diff(np.append(first, len(keys)))
        # the strings that are the smallest of some window, in order
        padded = np.concatenate((np.zeros(span - 1, np.uint64), keys, np.zeros(span - 1, np.uint64)))
        chosen = np.flatnonzero(sliding(np.maximum, padded, span) == h)
        again = np.concatenate(([0], np.cumsum(h[chosen[1:]] == h[chosen[:-1]]), [0]))  # equal neighbours before each
        lo, hi = np.searchsorted(chosen, first), np.searchsorted(chosen, first + n + span - 2, "right") - 1
        yield first + at, n, keys[first].view(np.int64), again[np.maximum(hi, lo)] > again[lo]


def _row_key(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias("_r1"), F.xxhash64(F.lit(7), F.col(text_col), F.col(id_col)).alias("_r2")]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


_SEGMENT = pa.schema([("_r1", pa.int64()), ("_r2", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()),
                      ("start", pa.int64()), ("n", pa.int64()), ("twice", pa.int64())])


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(_r1, _r2, key, lo, hi, start, n, twice) of every segment of ``docs`` (_r1,
    _r2, _text); lo and hi are the hash of its bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            held, n_held = [], 0
            for r1, r2, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = _bytes(text)
                for first, n, key, twice in segments_of(raw, length, gram):
                    hashes = b"".join(digest(raw[a: a + k + length - 1]) for a, k in zip(first.tolist(), n.tolist(), strict=True))
                    both = np.frombuffer(hashes, "<i8").reshape(-1, 2)
                    held.append((np.full(len(n), r1), np.full(len(n), r2), key, both[:, 0], both[:, 1], first, n, twice))
                    n_held += len(n)
                    if n_held > 1 << 16:
                        yield _batch(held)
                        held, n_held = [], 0
            if held:
                yield _batch(held)

    return docs.select("_r1", "_r2", "_text").mapInArrow(
        cut, "_r1 long, _r2 long, key long, lo long, hi long, start long, n long, twice long")


def _batch(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*held, strict=True)], schema=_SEGMENT)


def zipped(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text`` as compressed bytes, for the shuffles."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstd.ZstdCompressor(level=3).compress
        for batch in batches:
            cols = batch.columns
            yield pa.RecordBatch.from_arrays(
                [*cols[:-1], pa.array([pack(_bytes(t)) for t in cols[-1].to_pylist()], pa.binary())], [*batch.schema.names[:-1], "_zip"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "_text")
    return docs.select(*[c for c in docs.columns if c != "_text"], "_text").mapInArrow(squeeze, f"{kinds}, _zip binary")


def _contents(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(key, lo, hi, whole, content) of the segments in ``wanted``."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for p, content in _slices(batches, length):
            out.append((p["key"], p["lo"], p["hi"], p["whole"], content))
            size += len(content)
            if size > 4 << 20:
                yield _content_batch(out)
                out, size = [], 0
        yield _content_batch(out)

    return _with_texts(wanted, docs).mapInArrow(slices, "key long, lo long, hi long, whole boolean, content binary")


def _with_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The compressed texts that hold the segments in ``wanted``, with lists of these."""
    lists = wanted.groupBy("rep._r1", "rep._r2").agg(F.collect_list(F.struct("key", "lo", "hi", "whole", "rep.start", "n")).alias("parts"))
    return docs.join(lists, ["_r1", "_r2"]).select("_zip", "parts")


def _slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[dict, bytes]]:
    unpack = zstd.ZstdDecompressor().decompress
    for batch in batches:
        for raw, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = unpack(raw)
            for p in parts:
                yield p, raw[p["start"]: p["start"] + p["n"] + length - 1]


def repeats_by_window(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(key, lo, hi, runs) as ``repeats_in_shards`` has them, for segments of crowded keys: every
    window is a row, keyed by the hash of all its bytes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for p, content in _slices(batches, length):
            for at in range(0, p["n"], BLOCK >> 4):
                n = min(BLOCK >> 4, p["n"] - at)
                both = np.frombuffer(b"".join(digest(content[i: i + length]) for i in range(at, at + n)), "<i8").reshape(-1, 2)
                own = [pa.array(np.full(n, p[c])) for c in ("key", "lo", "hi", "whole")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(at, at + n)), pa.array(both[:, 0]), pa.array(both[:, 1])],
                                                 ["key", "lo", "hi", "whole", "at", "wlo", "whi"])

    each = written(_with_texts(wanted, docs).mapInArrow(windows, "key long, lo long, hi long, whole boolean, at long, wlo long, whi long")
                   .dropDuplicates(["key", "lo", "hi", "at"]), "windows")
    again = each.groupBy("wlo", "whi").agg(F.count(F.lit(1)).alias("w")).where("w > 1")
    hit = heavy_join(each, again, ["wlo", "whi"], "w", F.xxhash64("lo", "at"), how="left_semi")
    # a run of one window each; runs that touch become one span
    runs = F.flatten(F.transform(F.collect_list("at"), lambda x: F.array(x, x)))
    return hit.where("not whole").groupBy("key", "lo", "hi").agg(runs.alias("runs"))


def _content_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      ["key", "lo", "hi", "whole", "content"])


def repeats_in_shards(contents: DataFrame, length: int, shards: int, budget: int = induced_sort.BUDGET) -> DataFrame:
    """(key, lo, hi, runs): the windows of a segment that occur elsewhere in its
    shard, as first and last window of each run. One shard to a task."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [array("q") for _ in range(6)]  # key, lo, hi, whole, place, length of each segment
        shift = bytes(min(b + 2, 255) for b in range(256))  # 0 is the sentinel, 1 parts segments; UTF-8 ends at 0xF4
        at = 0
        with tempfile.SpooledTemporaryFile(max_size=budget) as spool:
            for batch in batches:
                for key, lo, hi, whole, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for c, v in zip(cols, (key, lo, hi, whole, at, len(content)), strict=True):
                        c.append(v)
                    spool.write(content.translate(shift) + b"\1")
                    at += len(content) + 1
            if not at:
                return
            spool.write(b"\0")
            spool.seek(0)
            if at < budget:
                text = np.frombuffer(spool.read(), np.uint8)
            else:
                spool.rollover()
                spool.flush()
                text = np.memmap(spool._file, np.uint8, "r")
            hit = induced_sort.repeats(text, length, budget)
            out = []
            for key, lo, hi, whole, begin, n in zip(*cols, strict=True):
                own = hit[begin: begin + n - length + 1]
                if not whole and own.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                    edge[1::2] -= 1
                    out.append((key, lo, hi, edge.tolist()))
                    if len(out) == 1 << 14:
                        yield _run_batch(out)
                        out = []
            yield _run_batch(out)

    return contents.repartition(shards, "key").mapInArrow(sort, "key long, lo long, hi long, runs array<long>")


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "lo", "hi", "runs"])


def cut_spans(raw: bytes, parts: list[dict], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, bytes kept)"""
    spans = sorted((p["start"] + a, p["start"] + b + length) for p in parts for a, b in zip(p["runs"][::2], p["runs"][1::2], strict=True))
    kept, at, n_runs, removed = [], 0, 0, 0
    end = -1
    for a, b in spans:
        if a > end:
            kept.append(raw[at:a])
            n_runs += 1
            removed += b - a
        elif b > end:
            removed += b - end
        end = max(end, b)
        at = end
    kept.append(raw[at:])
    return removed, n_runs, b"".join(kept)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 gram: int = GRAM, shards: int | None = None, budget: int = induced_sort.BUDGET) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary); one row per input row."""
    spark = prepare(docs.sparkSession)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).select("*", *_row_key("_id", "_text"))
    parts = written(segments(slim, length, gram), "segments")
    keys = parts.groupBy("key").agg(F.count(F.lit(1)).alias("w"), F.min("lo").alias("a"), F.max("lo").alias("b"), F.max("twice").alias("t"))
    keys = keys.withColumn("mixed", (F.col("a") != F.col("b")) | (F.col("t") > 0)).where("w > 1 or mixed").select("key", "w", "mixed")
    met = written(heavy_join(parts.drop("twice"), keys, ["key"], "w", F.xxhash64("_r1", "start"), how="inner"), "met")
    each = written(met.groupBy("key", "lo", "hi").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("_r1", "_r2", "start")).alias("rep"), F.first("n").alias("n"),
        F.max("mixed").alias("mixed")).withColumn("whole", F.col("c") > 1), "contents")
    packed = zipped(slim.select("_id", "_r1", "_r2", "_text"))
    mixed = each.where("mixed")
    crowds = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > CROWD).withColumn("crowded", F.lit(True))
    mixed = written(heavy_join(mixed, crowds, ["key"], "d", F.xxhash64("lo", "hi")), "mixed")
    texts = packed.select("_r1", "_r2", "_zip")
    sorted_runs = repeats_in_shards(_contents(mixed.where("crowded is null"), texts, length), length, shards, budget)
    if mixed.where("crowded").limit(1).count():
        sorted_runs = sorted_runs.union(repeats_by_window(mixed.where("crowded"), texts, length))
    found = sorted_runs.withColumn("c", F.lit(1).cast("long")).union(
        each.where("whole").select("key", "lo", "hi", F.array(F.lit(0).cast("long"), F.col("n") - 1).alias("runs"), "c"))
    # rows that repeat an id and text gave the same content twice
    found = written(found.groupBy("key", "lo", "hi").agg(F.first("runs").alias("runs"), F.max("c").alias("c")), "repeats")
    hits = heavy_join(met.select("key", "lo", "hi", "_r1", "_r2", "start"), found, ["key", "lo", "hi"], "c", F.xxhash64("_r1", "start"), how="inner")
    spans = hits.groupBy("_r1", "_r2").agg(F.collect_set(F.struct("start", "runs")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstd.ZstdDecompressor().decompress
        for batch in batches:
            ids, zips, lists = (batch.column(i) for i in range(3))
            rows, size = [], 0
            for i in range(batch.num_rows):
                raw = unpack(zips[i].as_py())
                removed, n_runs, kept = cut_spans(raw, lists[i].as_py() or [], length)
                rows.append((ids[i], len(raw), removed, n_runs, kept))
                size += len(kept)
                if size > 8 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0].as_py() for r in rows], ids.type), *[pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)],
                         pa.array([r[4] for r in rows], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])
                    rows, size = [], 0

    kind = dict(slim.dtypes)["_id"]
    out = packed.join(spans, ["_r1", "_r2"], "left").select("_id", "_zip", "parts").mapInArrow(
        cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)
