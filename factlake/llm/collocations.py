"""Phrase collocation mining with weighted automata.

Texts are cut into pieces at punctuation and line ends and pieces into words; a
phrase is a run of words in a piece. Everything is counted per language.
A phrase of two to ``LONGEST`` words with at least ``least`` occurrences is a candidate. Its
score is that of its weakest cut into a first part and a rest,
floor(1000 * a * n / (l * r)), with a, l and r the occurrences of phrase and parts and n
the words of the language. Candidates inside a longer candidate that is as frequent go.

How it is counted: the texts are read once and written as blocks, each the words
of a stretch of texts of one language as numbers into the block's own sorted
vocabulary. A phrase of k words can have ``least`` occurrences only if its two parts of k - 1 words
do. So hashes of phrases are summed length by length over all blocks, only of those whose parts
stood, dealt out by ranges of the hash; what reaches ``least`` is known to all tasks as a
bit filter of fixed size (``FILTER_BITS``). A filter may let rare phrases through, which costs
time and changes no count.

Then every shard (the blocks of a task, up to ``SHARD_KEYS`` phrases) gathers its phrases as arrays, in which they
meet by hash and are compared word by word, and builds count transducers from its
sorted phrases of all lengths, one for each prefix range (``count_automata``). Transducers of a
range meet in one task, which unites them, sums their weights and keeps the phrases with
``least`` occurrences: these counts are those of the words themselves, not of hashes.
Parts of candidates are looked up by composition: the parts asked for become a transducer of their
prefix range, which is walked together with the range's counts.

Prefix ranges are cut at phrases found in a few blocks, so that a word which begins a
third of all phrases is cut into several; the cuts decide where a phrase is
counted and nothing else. A block holds at most ``BLOCK_WORDS`` words, also of one text;
phrases across two blocks of a text are counted in the second.

Defined cases: a null text is empty; a null language is ``und`` (and one with
a row of that name); rows that repeat count as often as they occur; a language
without candidates has no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, prepare, written
from .count_automata import Automaton, Key, build, compose, union

LONGEST = 5
LEAST = 100
BLOCK_WORDS = 1 << 20
#: Bytes of a text that are split at a time.
SLICE = 1 << 20
FILTER_BITS = 1 << 27
#: Bits of a hash that are summed: phrases that share them only look more frequent than they are.
HASH_BITS = 48
#: Blocks and phrases of each from which the cuts of the prefix ranges are taken.
SAMPLED_BLOCKS, SAMPLED_PHRASES = 8, 2000
#: Phrases that a task holds, as arrays of some 40 bytes each, before it builds transducers from them.
SHARD_KEYS = 1_000_000
#: Bytes of transducers that are united at a time.
UNITE_BYTES = 32 << 20

#: A-Z to a-z, punctuation and line ends to \n, tab to space.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0a\x0b\x0c\x0d" + b"\t",
                        b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")

_AUTOMATON = "labels array<binary>, shape binary, counts binary"
_AUTOMATON_FIELDS = [("labels", pa.list_(pa.binary())), ("shape", pa.binary()), ("counts", pa.binary())]


# --- blocks ---------------------------------------------------------------------------------


class _Open:
    """The words of one language that are not in a block yet."""

    def __init__(self) -> None:
        self.carry = 0
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids: list[int] = []  # -1 ends a piece

    def take(self, lang: str, carry: int) -> tuple:
        """The block; its last ``carry`` words begin the next one."""
        words = sorted(self.numbers)
        place = np.empty(len(words) + 1, np.int32)
        place[-1] = -1
        place[[self.numbers[w] for w in words]] = np.arange(len(words), dtype=np.int32)
        ids = place[np.array(self.ids, np.int64)]
        n = int((ids >= 0).sum()) - self.carry
        out = (uuid.uuid4().hex, lang, n, self.carry, b"\n".join(words), zstd.ZstdCompressor(level=3).compress(ids.tobytes()))
        kept = [words[i] for i in ids[len(ids) - carry:].tolist()] if carry else []
        self.clear()
        self.ids = [self.numbers[w] for w in kept]
        self.carry = len(kept)
        return out


def blocks(docs: DataFrame, longest: int = LONGEST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, lang, n, carry, vocabulary, ids): the texts' words as numbers into the block's
    vocabulary. The first ``carry`` words were counted in another block."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Open] = defaultdict(_Open)
        held = 0
        for batch in batches:
            for lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                raw = (text or "").encode("utf-8", "replace").translate(_FOLD)
                own, at = open_[lang], 0
                before = len(own.ids)
                while at < len(raw):
                    end = min(at + SLICE, len(raw))
                    while end < len(raw) and raw[end] not in b" \n":
                        space, line = raw.find(b" ", end), raw.find(b"\n", end)
                        end = min(x for x in (space, line, len(raw)) if x >= 0)
                    for k, piece in enumerate(raw[at:end].split(b"\n")):
                        if k:
                            own.ids.append(-1)
                        own.ids += map(own.numbers.__getitem__, piece.split())
                    at = end
                    if len(own.ids) > block_words and at < len(raw):  # inside a text: phrases may go on
                        tail = own.ids[-(longest - 1):] if longest > 1 else []
                        carry = next((k for k, x in enumerate(reversed(tail)) if x < 0), len(tail))
                        held += len(own.ids) - before
                        yield _block_batch([own.take(lang, carry)])
                        held, before = held - before, len(own.ids)
                        held = max(held, 0)
                own.ids.append(-1)
                held += len(own.ids) - before
                if held > 2 * block_words or len(own.ids) > block_words:
                    yield _block_batch([o.take(x, 0) for x, o in open_.items() if o.ids])
                    open_.clear()
                    held = 0
        rows = [o.take(x, 0) for x, o in open_.items() if o.ids]
        if rows:
            yield _block_batch(rows)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(
        encode, "block string, lang string, n long, carry int, vocabulary binary, ids binary")


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      ["block", "lang", "n", "carry", "vocabulary", "ids"])


# --- phrases of a block ---------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on with a word."""
    return _mixed(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace"))
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)


class BitFilter:
    """A set of hashes as bits. It may hold more than was put in, never less."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - HASH_BITS)) % np.uint64(FILTER_BITS)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Block:
    """The phrases of one block."""

    def __init__(self, lang: str, carry: int, vocabulary: bytes, ids: bytes):
        self.carry = carry
        self.words = vocabulary.split(b"\n") if vocabulary else []
        self.ids = np.frombuffer(zstd.ZstdDecompressor().decompress(ids), np.int32).astype(np.int64)
        self.hashes = _word_hashes(lang, self.words)
        # the pieces' ends so far: phrases with one inside are none
        self.ends = np.concatenate(([0], np.cumsum(self.ids < 0)))

    def hashed(self, longest: int, frequent: BitFilter | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length up to ``longest``: where phrases start whose parts are all in
        ``frequent``, and their hashes. Phrases that end in the carried words were counted before."""
        own = self.hashes[np.maximum(self.ids, 0)] if self.words else np.zeros(len(self.ids), np.uint64)
        at = np.flatnonzero(self.ids >= 0)
        h = own[at]
        for k in range(1, longest + 1):
            if k > 1:
                ok = np.zeros(len(self.ids) + 1, bool)
                ok[at[frequent(h)]] = True
                at = at[ok[at] & ok[at + 1]]  # both parts of k - 1 words
                at = at[at + k <= len(self.ids)]
                at = at[self.ends[at + k] == self.ends[at]]
                h = own[at]
                for j in range(1, k):
                    h = _longer(h, own[at + j])
                h = h ^ np.uint64(k)  # words are no phrases of another length
            keep = at + k > self.carry
            yield at[keep], h[keep]

    def counts(self, at: np.ndarray, k: int) -> Iterator[tuple[Key, int]]:
        """The phrases of ``k`` words that start there, in order, with their counts."""
        if not len(at):
            return
        # rank of the first words, then of one word more each time
        rank, found = self.ids[at], None
        for j in range(k):
            key = rank if j == 0 else rank * len(self.words) + self.ids[at + j]
            _, found, rank, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        words, at = self.words, at[found]
        for i, c in zip(at.tolist(), n.tolist(), strict=True):
            yield tuple(words[x] for x in self.ids[i: i + k].tolist()), c


def _hash_sums(level: DataFrame, k: int, least: int, slices: int, frequent) -> DataFrame:
    """(bit) of the phrases of ``k`` words whose hash occurs ``least`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = BitFilter(frequent.value) if frequent is not None else None
        edges = [(i << HASH_BITS) // slices for i in range(1, slices)]
        held: list[np.ndarray] = []
        for batch in batches:
            for _, lang, _, carry, vocabulary, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                *_, (_, h) = Block(lang, carry, vocabulary, ids).hashed(k, known)
                held.append(h)
                if sum(map(len, held)) > 4 * BLOCK_WORDS:
                    yield _hash_batch(held, edges)
                    held = []
        if held:
            yield _hash_batch(held, edges)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(rows, key=itemgetter(0)):
            h, n, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
            for _, hashes, counts in group:
                held.append(_unpacked(hashes, counts))
                size += 16 * len(held[-1][0])
                if size > UNITE_BYTES:
                    h, n = _summed([(h, n), *held])
                    held, size = [], 0
            h, n = _summed([(h, n), *held])
            yield pa.RecordBatch.from_arrays([pa.array((h[n >= least] % np.uint64(FILTER_BITS)).astype(np.int64))], ["bit"])

    each = level.mapInArrow(count, "slice int, hashes binary, counts binary")
    return each.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(add, "bit long")


def _hash_batch(held: list[np.ndarray], edges: list[int]) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(held) >> np.uint64(64 - HASH_BITS), return_counts=True)
    at = [0, *np.searchsorted(h, np.array(edges, np.uint64)).tolist(), len(h)]
    rows = [(i, *_packed(h[a:b], n[a:b])) for i, (a, b) in enumerate(zip(at, at[1:])) if a < b]  # noqa: B905
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                                       pa.array([r[2] for r in rows], pa.binary())], ["slice", "hashes", "counts"])


def _packed(h: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Rising hashes as differences, and counts, both byte plane by byte plane, compressed."""
    steps = np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    pack = zstd.ZstdCompressor(level=1).compress
    return pack(steps.T.tobytes()), pack(n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstd.ZstdDecompressor().decompress
    steps, n = (np.ascontiguousarray(np.frombuffer(unpack(raw), np.uint8).reshape(w, -1).T) for raw, w in ((hashes, 8), (counts, 4)))
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64), n.view("<u4").ravel().astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def _transducers(level: DataFrame, longest: int, cuts: list[Key], frequent) -> DataFrame:
    """(range, automaton) of every shard's phrases. Keys begin with the language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = BitFilter(frequent.value)
        held = _Shard(longest)
        for batch in batches:
            for _, lang, _, carry, vocabulary, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.add(lang, Block(lang, carry, vocabulary, ids), known)
                if held.size > SHARD_KEYS and held.merged() > SHARD_KEYS:
                    yield held.built(cuts)
                    held = _Shard(longest)
        if held.size:
            yield held.built(cuts)

    return level.mapInArrow(count, f"range int, {_AUTOMATON}")


def _phrases(lang: str, carry: int, vocabulary: bytes, ids: bytes, longest: int, known: BitFilter) -> Iterator[tuple[Key, int]]:
    block, name = Block(lang, carry, vocabulary, ids), (lang.encode("utf-8", "replace"),)
    for k, (at, h) in enumerate(block.hashed(longest, known), 1):
        for key, n in block.counts(at[known(h)], k):
            yield name + key, n


class _Rows:
    """Phrases of one language and shard: hashes that rise, counts, and the words as numbers (-1 behind the
    last). Phrases meet by hash and are compared word by word; one whose hash another phrase has is kept aside."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.numbers: dict[bytes, int] = {}
        self.met = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, longest), np.int32))
        self.new: list[tuple] = []
        self.aside: list[tuple] = []
        self.pending = 0

    def put(self, h: np.ndarray, n: np.ndarray, words: np.ndarray) -> None:
        self.new.append((h, n, words))
        self.pending += len(h)
        if self.pending > max(len(self.met[0]), BLOCK_WORDS):
            self.merge()

    def merge(self) -> None:
        h, n, words = (np.concatenate(c) for c in zip(self.met, *self.new, strict=True))
        order = np.argsort(h, kind="stable")
        h, n, words = h[order], n[order], words[order]
        first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        begin = np.flatnonzero(first)
        other = (words != words[begin[np.cumsum(first) - 1]]).any(axis=1)
        if other.any():
            self.aside.append((n[other], words[other]))
            n = np.where(other, 0, n)
        self.met = (h[begin], np.add.reduceat(n, begin) if len(h) else n, words[begin])
        self.new, self.pending = [], 0

    def done(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(words in order, phrases in order as numbers of these, counts)."""
        self.merge()
        known = sorted(self.numbers)
        place = np.empty(len(known) + 1, np.int32)
        place[-1] = -1
        place[[self.numbers[w] for w in known]] = np.arange(len(known), dtype=np.int32)
        n, words = (np.concatenate(c) for c in zip(self.met[1:], *self.aside, strict=True))
        words = place[words]
        order = np.lexsort(words.T[::-1])
        n, words = n[order], words[order]
        begin = np.flatnonzero(np.concatenate(([len(n) > 0], (words[1:] != words[:-1]).any(axis=1)))[:len(n)])
        return known, words[begin], np.add.reduceat(n, begin) if len(n) else n


class _Shard:
    """The phrases of some blocks, as arrays until transducers are built from them."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.rows: dict[bytes, _Rows] = {}

    @property
    def size(self) -> int:
        return sum(len(r.met[0]) + r.pending for r in self.rows.values())

    def merged(self) -> int:
        """The number of different phrases."""
        for rows in self.rows.values():
            rows.merge()
        return self.size

    def add(self, lang: str, block: Block, known: BitFilter) -> None:
        own = self.rows.setdefault(lang.encode("utf-8", "replace"), _Rows(self.longest))
        number = np.full(len(block.words) + 1, -1, np.int32)
        for k, (at, h) in enumerate(block.hashed(self.longest, known), 1):
            stood = known(h)
            at, h = at[stood], h[stood]
            if not len(at):
                continue
            _, found, group, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            starts = at[found]
            same = np.ones(len(at), bool)
            for j in range(k):
                same &= block.ids[at + j] == block.ids[starts[group] + j]
            if not same.all():  # phrases that share a hash: each is a row of its own
                n = np.bincount(group[same], minlength=len(found))
                starts, n, found = np.concatenate((starts, at[~same])), np.concatenate((n, np.ones((~same).sum(), np.int64))), np.concatenate((found, np.flatnonzero(~same)))
            ids = block.ids[starts[:, None] + np.arange(k)]
            for w in np.unique(ids[number[ids] < 0]).tolist():
                number[w] = own.numbers.setdefault(block.words[w], len(own.numbers))
            words = np.full((len(starts), self.longest), -1, np.int32)
            words[:, :k] = number[ids]
            own.put(h[found], n.astype(np.int64), words)

    def built(self, cuts: list[Key]) -> pa.RecordBatch:
        names = sorted(self.rows)
        parts = [self.rows.pop(name).done() for name in names]
        ends = np.cumsum([len(n) for _, _, n in parts]).tolist()

        def key(i: int) -> Key:
            p = bisect_right(ends, i)
            known, words, _ = parts[p]
            return (names[p], *(known[w] for w in words[i - ends[p]].tolist() if w >= 0))

        def items(a: int, b: int) -> Iterator[tuple[Key, int]]:
            for name, (known, words, n), end in zip(names, parts, ends, strict=True):
                begin = end - len(n)
                for x in range(max(a, begin), min(b, end), 4096):
                    own = slice(x - begin, min(b, end, x + 4096) - begin)
                    for row, c in zip(words[own].tolist(), n[own].tolist(), strict=True):
                        yield (name, *(known[w] for w in row if w >= 0)), c

        # a phrase's range is the number of cuts before it: where the cuts fall among the phrases
        total = ends[-1]
        edges = [0, *(bisect_right(range(total), c, key=key) for c in cuts), total]
        return _automaton_batch([(r, *build(items(a, b)).pack())
                                 for r, (a, b) in enumerate(zip(edges, edges[1:])) if a < b])  # noqa: B905  one more edge than ranges


def _automaton_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("range", pa.int32()), *_AUTOMATON_FIELDS]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def _cuts(level: DataFrame, longest: int, frequent, ranges: int) -> list[Key]:
    """Keys that cut the phrases of a few blocks into ``ranges`` equal parts."""
    chosen = [r.block for r in level.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLED_BLOCKS).collect()]

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = BitFilter(frequent.value)
        for batch in batches:
            for _, lang, _, carry, vocabulary, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = sorted(key for key, _ in _phrases(lang, carry, vocabulary, ids, longest, known))
                step = max(1, -(-len(keys) // SAMPLED_PHRASES))
                yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in keys[::step]], pa.list_(pa.binary())),
                                                  pa.array([step] * len(keys[::step]), pa.int64())], ["words", "w"])

    rows = level.where(F.col("block").isin(chosen)).mapInArrow(some, "words array<binary>, w long").collect() if chosen else []
    sample = sorted((tuple(map(bytes, r.words)), r.w) for r in rows)
    total, seen, cuts = sum(w for _, w in sample), 0, []
    for key, w in sample:
        seen += w
        if len(cuts) < ranges - 1 and seen * ranges >= (len(cuts) + 1) * total and key not in cuts[-1:]:
            cuts.append(key)
    return cuts


def _united(pieces: DataFrame, ranges: int, least: int) -> DataFrame:
    """One transducer a range, with the sums of ``least`` and more."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for r, group in groupby(rows, key=itemgetter(0)):
            held: list[Automaton] = []
            size = 0
            for _, labels, shape, counts in group:
                held.append(Automaton.unpack(labels, shape, counts))
                size += len(shape) + len(counts)
                if size > UNITE_BYTES:
                    held, size = [union(held)], 0
            yield _automaton_batch([(r, *union(held, least).pack())])

    return pieces.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(unite, f"range int, {_AUTOMATON}")


def entries(counts: DataFrame) -> DataFrame:
    """(lang, phrase, k, f) of every key of the transducers ``counts``."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, labels, shape, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(Automaton.unpack(labels, shape, counts).items())
                yield pa.RecordBatch.from_arrays(
                    [*_spelt([key for key, _ in rows]), pa.array([len(key) - 1 for key, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.int64())],
                    ["lang", "phrase", "k", "f"])

    return counts.mapInArrow(spell, "lang string, phrase string, k int, f long")


def _spelt(keys: list[Key]) -> list[pa.Array]:
    return [pa.array([key[0].decode("utf-8", "replace") for key in keys], pa.string()),
            pa.array([b" ".join(key[1:]).decode("utf-8", "replace") for key in keys], pa.string())]


def _key(lang: str, phrase: str) -> Key:
    return (lang.encode("utf-8", "replace"), *phrase.encode("utf-8", "replace").split(b" "))


class Counts:
    """The phrases of ``docs`` (lang, text) of up to ``longest`` words that occur ``least`` times or
    more: ``table`` holds their transducers by prefix range."""

    def __init__(self, docs: DataFrame, longest: int = LONGEST, least: int = LEAST, ranges: int | None = None, block_words: int = BLOCK_WORDS):
        spark = prepare(docs.sparkSession)
        self.ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.blocks = written(blocks(docs, longest, block_words), "phrase-blocks")
        bits, frequent = bytearray(FILTER_BITS // 8), None
        for k in range(1, longest + 1):
            self._add(bits, _hash_sums(self.blocks, k, least, self.ranges, frequent))
            if frequent is not None:
                frequent.unpersist()
            frequent = spark.sparkContext.broadcast(bytes(bits))
        self.cuts = _cuts(self.blocks, longest, frequent, self.ranges)
        self.table = written(_united(_transducers(self.blocks, longest, self.cuts, frequent), self.ranges, least), "phrase-counts")

    @staticmethod
    def _add(bits: bytearray, found: DataFrame) -> None:
        """Put (bit) into a filter: FILTER_BITS / 8 bytes, whatever the input."""
        at = F.col("bit") + 1  # buckets of bits begin at 1
        each = found.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        for r in each.collect():
            own = slice((r.b - 1) * 4096, r.b * 4096)
            bits[own] = (int.from_bytes(bits[own], "big") | int.from_bytes(r.bits, "big")).to_bytes(4096, "big")

    def entries(self) -> DataFrame:
        """(lang, phrase, k, f) of all counted phrases."""
        return entries(self.table)

    def words(self) -> DataFrame:
        """(lang, n): all words of a language."""
        return self.blocks.groupBy("lang").agg(F.sum("n").alias("n"))

    def lookup(self, asked: DataFrame) -> DataFrame:
        """(lang, phrase, f) of the rows (lang, phrase) of ``asked`` that were
        counted, each once: composition range by range."""
        cuts = self.cuts

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = [bisect_left(cuts, _key(lang, phrase)) for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["range", "lang", "phrase"])

        mine = asked.select("lang", "phrase").distinct().mapInArrow(place, "range int, lang string, phrase string")
        blank = [F.lit(None).cast("string").alias(c) for c in ("lang", "phrase")]
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.table.schema.fields if f.name != "range"]
        # a range's transducer first, then what is asked of it
        both = self.table.select("range", *blank, "labels", "shape", "counts").union(mine.select("*", *none))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for _, group in groupby(rows, key=itemgetter(0)):
                _, lang, _, *packed = next(group)
                if lang is not None:
                    continue  # nothing was counted in this range
                keys = sorted(_key(lang, phrase) for _, lang, phrase, *_ in group)
                got = list(compose(build((key, 1) for key in keys), Automaton.unpack(*packed)))
                yield pa.RecordBatch.from_arrays([*_spelt([key for key, _ in got]), pa.array([c for _, c in got], pa.int64())], ["lang", "phrase", "f"])

        return (both.repartition(self.ranges, "range").sortWithinPartitions("range", F.asc_nulls_first("lang"), "phrase")
                .mapInArrow(walk, "lang string, phrase string, f long"))


def score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)). Exact: the products have at most 38 digits."""
    top = (F.lit(1000).cast("decimal(4,0)") * F.col(a).cast("decimal(15,0)")).cast("decimal(19,0)") * F.col(n).cast("decimal(18,0)")
    low = F.col(l).cast("decimal(18,0)") * F.col(r).cast("decimal(18,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), low.cast("decimal(38,0)"))


def mined(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST,
          ranges: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of every candidate that stays."""
    counts = Counts(docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), longest, least, ranges, block_words)
    candidates = written(counts.entries().where("k >= 2").withColumnRenamed("f", "a"), "phrase-candidates")
    words = F.split("phrase", " ")
    cut = F.explode(F.expr("sequence(1, k - 1)"))
    cuts = candidates.select("lang", "phrase", "k", "a", cut.alias("cut"))
    parts = cuts.select("lang", "phrase", "k", "a", "cut", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("part")),
        F.struct(F.lit("r").alias("side"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("k")), " ").alias("part")),
    )).alias("p")).select("lang", "phrase", "k", "a", "cut", "p.side", "p.part")
    parts = written(parts, "phrase-parts")
    askers = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("w"))
    found = counts.lookup(parts.select("lang", F.col("part").alias("phrase")))
    known = written(found.withColumnRenamed("phrase", "part").join(askers, ["lang", "part"]), "phrase-lookups")
    met = heavy_join(parts, known, ["lang", "part"], "w", F.xxhash64("phrase", "cut"), how="inner")
    side = {s: F.max(F.when(F.col("side") == s, F.col("f"))) for s in "lr"}
    each = written(met.groupBy("lang", "phrase", "k", "a", "cut").agg(side["l"].alias("l"), side["r"].alias("r")), "phrase-cuts")
    # a part of all words but one that is as frequent as the whole goes
    whole = each.where("a = l and cut = k - 1 and k > 2").select("lang", F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " ").alias("phrase")).union(
        each.where("a = r and cut = 1 and k > 2").select("lang", F.array_join(F.slice(words, F.lit(2), F.col("k")), " ").alias("phrase"))).distinct()
    totals = counts.words().join(candidates.groupBy("lang").agg(F.count(F.lit(1)).alias("w")), "lang")
    scored = heavy_join(each.join(whole, ["lang", "phrase"], "left_anti"), totals, ["lang"], "w", F.xxhash64("phrase", "cut"), how="inner")
    scored = scored.withColumn("score", score("a", "n", "l", "r"))
    best = scored.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", "n", "b.score")
