"""Token ids in directly addressable codes.

An id is cut into chunks of ``CHUNK`` bits. Level 0 holds the lowest chunk of
every id, level 1 the next chunk of those ids that have one, and so on; each
level has a bitmap that says which of its entries go on, and a directory of
ranks that counts those bits before each ``RANK`` bits. The entry of an id on
the next level is the rank of its bit, so any id is read by a few lookups,
without decoding a block.

File: segments one after the other, then their directory, then a trailer.

    segment   "DAC1", u32 n, u32 levels, then per level: u32 n, chunks (u8),
              and, but for the last, bitmap (u8, low bit first), ranks (u32)
    directory per segment: u64 offset, u64 first token (within the file), u32 n
    index     per document: i64 doc_id, u8 null flag, u64 first token, u32 n
    trailer   u64 directory offset, u32 segments, u64 index offset, u64
              documents, "DACF"

All integers are little-endian. Documents are range-partitioned by doc_id and
sorted; a task encodes its range and writes one file, holding one segment at
a time. The file's name is its own for each attempt, and only names that a
finished task returned enter the manifest, a written table; what a lost
executor left behind is never read.

Defined cases: a null or empty text has the end id only; a null doc_id sorts
first; rows that repeat a doc_id follow each other in the order of their
texts; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LATIN_END, MARKS, Parting, byte_alphabet
from .common import open_store, prepare, shared_folder, written

CHUNK = 8
RANK = 512
#: Tokens of a segment: what a writer or reader holds at once.
SEGMENT = 1 << 20
#: Appended to every document.
END_ID = 1
#: Rows handled at a time, and words.
BLOCK, LOOKED_UP = 1 << 16, 1 << 18
#: Entries of a worker's memo, which starts anew when full.
WORDS = 1_000_000

_DIR = np.dtype([("offset", "<u8"), ("first", "<u8"), ("n", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("first", "<u8"), ("n", "<u4")])
_TRAILER = struct.Struct("<QIQQ4s")


# ---- the code ---------------------------------------------------------------

def pack(ids: np.ndarray) -> bytes:
    """One segment."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK
        goes_on = more > 0
        last = not goes_on.any()
        part = [struct.pack("<I", len(rest)), (rest & ((1 << CHUNK) - 1)).astype(np.uint8).tobytes()]
        if not last:
            bits = np.packbits(goes_on, bitorder="little")
            sums = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK), dtype=np.uint32)
            part += [bits.tobytes(), np.concatenate(([0], np.cumsum(sums)[:-1])).astype("<u4").tobytes()]
        levels.append(b"".join(part))
        if last:
            return b"DAC1" + struct.pack("<II", len(ids), len(levels)) + b"".join(levels)
        rest = more[goes_on]


class Segment:
    """A packed segment: ``seg[i]`` by directory lookups, ``seg.ids()`` whole."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"DAC1":
            raise ValueError("not a segment")
        self.n, count = struct.unpack_from("<II", raw, 4)
        at, self.levels = 12, []
        for k in range(count):
            (n,) = struct.unpack_from("<I", raw, at)
            chunks = np.frombuffer(raw, np.uint8, n, at + 4)
            at += 4 + n
            bits = ranks = None
            if k < count - 1:
                bits = np.frombuffer(raw, np.uint8, -(-n // 8), at)
                at += len(bits)
                ranks = np.frombuffer(raw, "<u4", -(-n // RANK), at)
                at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK
            before = np.unpackbits(bits[block * RANK // 8: (i >> 3) + 1], bitorder="little")
            i = int(ranks[block]) + int(before[: i - block * RANK].sum())
            shift += CHUNK
        return value

    def ids(self) -> np.ndarray:
        value = None
        for chunks, bits, _ in reversed(self.levels):
            own = chunks.astype(np.uint32)
            if value is not None:
                own[np.unpackbits(bits, bitorder="little", count=len(chunks)).astype(bool)] |= value << CHUNK
            value = own
        return value


class StoreWriter:
    """Writes one file, a segment at a time."""

    def __init__(self, sink):
        self.sink, self.held, self.n_held = sink, [], 0
        self.dir, self.docs, self.tokens = [], [], 0

    def add(self, doc_id: int | None, blocks: Iterator[np.ndarray]) -> None:
        first = self.tokens
        for ids in blocks:
            self.held.append(ids)
            self.n_held += len(ids)
            self.tokens += len(ids)
            while self.n_held >= SEGMENT:
                self._flush(SEGMENT)
        self.docs.append((doc_id or 0, doc_id is None, first, self.tokens - first))

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held)
        self.held, self.n_held = [ids[n:]], len(ids) - n
        self.dir.append((self.sink.tell(), self.tokens - self.n_held - len(ids[:n]), len(ids[:n])))
        self.sink.write(pack(ids[:n]))

    def close(self) -> None:
        if self.n_held:
            self._flush(self.n_held)
        at = self.sink.tell()
        self.sink.write(np.array(self.dir, _DIR).tobytes())
        index = self.sink.tell()
        self.sink.write(np.array(self.docs, _DOC).tobytes())
        self.sink.write(_TRAILER.pack(at, len(self.dir), index, len(self.docs), b"DACF"))


class StoreReader:
    """A file in directly addressable codes: ids by position, documents in order."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        at, n_dir, index, n_docs, mark = _TRAILER.unpack(self._at(size - _TRAILER.size, _TRAILER.size))
        if mark != b"DACF":
            raise ValueError("not a token file")
        self.end = at
        self.dir = np.frombuffer(self._at(at, n_dir * _DIR.itemsize), _DIR)
        self.index, self.n_docs = index, n_docs
        self._open: tuple[int, Segment] | None = None

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def segment(self, k: int) -> Segment:
        if self._open is None or self._open[0] != k:
            stop = int(self.dir["offset"][k + 1]) if k + 1 < len(self.dir) else self.end
            start = int(self.dir["offset"][k])
            self._open = k, Segment(self._at(start, stop - start))
        return self._open[1]

    def __getitem__(self, i: int) -> int:
        """The id at a position of the file."""
        k = int(np.searchsorted(self.dir["first"], i, "right")) - 1
        return self.segment(k)[i - int(self.dir["first"][k])]

    def ids(self, first: int, n: int) -> Iterator[np.ndarray]:
        """n ids from ``first`` on, in pieces of a segment at most."""
        k = int(np.searchsorted(self.dir["first"], first, "right")) - 1
        held = self._whole
        while n:
            if held is None or held[0] != k:
                held = self._whole = k, self.segment(k).ids()
            at = first - int(self.dir["first"][k])
            piece = held[1][at: at + n]
            yield piece
            first, n, k = first + len(piece), n - len(piece), k + 1

    _whole: tuple[int, np.ndarray] | None = None

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, first token, tokens) in file order."""
        for at in range(0, self.n_docs, BLOCK):
            n = min(BLOCK, self.n_docs - at)
            rows = np.frombuffer(self._at(self.index + at * _DOC.itemsize, n * _DOC.itemsize), _DOC)
            for doc_id, null, first, count in rows.tolist():
                yield None if null else doc_id, first, count


# ---- encoding with the tokenizers library -----------------------------------

class LibraryEncoder:
    """Ids by the tokenizers library through a bounded memo of words: this
    vocabulary's pre-tokens never cross white space, so a text's ids are the
    ids of its words in order. Words new to the memo are parted into pre-tokens,
    which the library's model encodes; words that the parting does not know go
    through the library whole. Texts that follow each other are looked up
    together, so that each word is once for many."""

    def __init__(self, path: str):
        self.parting = Parting(path)
        self.tokenizer = self.parting.tokenizer
        self.model = self.tokenizer.model
        self.shown = dict(enumerate(byte_alphabet()))
        self.marks = {m: self._piece(m) for m in MARKS}
        self.memo: dict[bytes, bytes] = {}

    def _learn(self, words: Iterable[bytes]) -> list[bytes]:
        """The ids of words new to the memo."""
        plain, piece, marks, tokenize = self.parting.plain, self._piece, self.marks, self.model.tokenize
        words, lettered = list(words), self.parting.lettered
        ids, ends = [], [0]
        for word in words:
            if lettered and word.isalpha():  # letters of ASCII, most words: their own only pre-token
                ids += [t.id for t in tokenize(word.lower().decode())]
                ends.append(4 * len(ids))
                continue
            parts = plain(word)
            if parts is None:
                text = word.decode("utf-8", "replace")
                if "<|" in text or not text.isascii() and max(text) >= LATIN_END:
                    ids += self.tokenizer.encode(text, add_special_tokens=False).ids
                    parts = ()
                else:
                    parts = self.parting.parted(text)
            for p in parts:
                ids += marks[p] if p in marks else piece(p)
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        out = [raw[begin:end] for begin, end in pairwise(ends)]
        if len(self.memo) + len(words) > WORDS:
            self.memo.clear()
        self.memo.update(zip(words, out, strict=True))
        return out

    def _piece(self, raw: bytes) -> list[int]:
        """The ids of one pre-token, by the library's model."""
        return [t.id for t in self.model.tokenize(raw.decode() if raw.isalpha() else raw.decode("latin-1").translate(self.shown))]

    def _coded(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of these words. The memo is large and slow to look into: once for each."""
        words = dict.fromkeys(words)
        known = dict(zip(words, map(self.memo.get, words), strict=True))
        new = [w for w, ids in known.items() if ids is None]
        if new:
            known.update(zip(new, self._learn(new), strict=True))
        return known

    def blocks(self, text: str | None) -> Iterator[np.ndarray]:
        words = _words(text)
        for at in range(0, len(words), LOOKED_UP):
            got = words[at: at + LOOKED_UP]
            yield np.frombuffer(b"".join(map(self._coded(got).__getitem__, got)), "<u4")

    def each(self, texts: Iterable[str | None]) -> Iterator[Iterable[np.ndarray]]:
        """The blocks of each text, to be read before the next is asked for. New
        words of neighbouring texts are learned at once."""
        held, n = [], 0
        for text in texts:
            words = _words(text)
            held.append(words)
            n += len(words)
            if n >= LOOKED_UP:
                long = held.pop() if len(words) >= LOOKED_UP else None
                yield from self._together(held)
                held, n = [], 0
                if long is not None:
                    yield self.blocks(text)
        yield from self._together(held)

    def _together(self, held: list[list[bytes]]) -> Iterator[Iterable[np.ndarray]]:
        get = self._coded(chain.from_iterable(held)).__getitem__
        for words in held:
            yield (np.frombuffer(b"".join(map(get, words)), "<u4"),)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


@functools.cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


# ---- the Spark jobs ---------------------------------------------------------

def write_store(docs: DataFrame, tokenizer: str, folder: str, files: int | None = None,
                id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the token files of ``docs`` below ``folder``, a path or URI that all
    executors share. Returns the manifest (path, first_doc, n_docs, n_tokens,
    start), ``start``: the tokens of all files before, in doc_id order."""
    spark = prepare(docs.sparkSession)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        name = f"tokens-{uuid.uuid4().hex}.dac"
        writer = sink = None
        enc = library_encoder(tokenizer)
        rank = 0
        for batch in batches:
            ids, texts, ranks = (batch.column(i) for i in range(3))
            if writer is None and batch.num_rows:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/{name}")
                writer, rank = StoreWriter(sink), ranks[0].as_py()
            for doc_id, blocks in zip(ids.to_pylist(), enc.each(t.as_py() for t in texts), strict=True):
                writer.add(doc_id, _ended(blocks, end_id))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({
                "path": [f"{folder}/{name}"], "part": pa.array([rank], pa.int32()),
                "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([writer.tokens], pa.int64())})

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranged = (slim.repartitionByRange(files, F.col("id").asc_nulls_first(), F.xxhash64("text"))
              .sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
              .withColumn("part", F.spark_partition_id()))
    made = written(ranged.mapInArrow(write, "path string, part int, n_docs long, n_tokens long"), "token-files")
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _ended(blocks: Iterable[np.ndarray], end_id: int) -> Iterator[np.ndarray]:
    yield from blocks
    yield np.array([end_id], "<u4")


def read_store(manifest: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    prepare(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                with store.open_input_file(path) as source:
                    reader, out = StoreReader(source), []
                    for doc_id, first, n in reader.documents():
                        crc = 0
                        for piece in reader.ids(first, n):
                            crc = zlib.crc32(piece.astype("<u4", copy=False), crc)
                        out.append((doc_id, row["start"] + first, n, crc))
                        if len(out) >= BLOCK:
                            yield _rows(out, id_name)
                            out = []
                    yield _rows(out, id_name)

    # a file to a task
    files = manifest.select("path", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return files.mapInArrow(read, f"`{id_name}` long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple], id_name: str) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [id_name, "start", "n_tokens", "ids_crc32"])


def token_store(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the store into the shared folder and read every document back."""
    return read_store(write_store(docs, tokenizer, shared_folder(docs.sparkSession, "tokens"),
                                  id_col=id_col, text_col=text_col))
