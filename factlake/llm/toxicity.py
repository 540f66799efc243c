"""Toxicity by compression distance.

Zstandard dictionaries are trained apart on ordinary and on toxic text (one toxic; ``SETS``
ordinary ones, whose mean counts). A text is cut into windows of one word each; every window is compressed with
either dictionary, and the share of its length that the toxic one saves is the
window's distance. A text's score is a calibrated logistic function of its
windows' distances: the largest, and how many reach each threshold, over all windows and over
those that the toxic dictionary covers as fully as its own words.

A word of a few bytes leaves a compressor little to save: what a match spares is as
much as what it costs to name it. So every byte of a window is written ``REPEAT`` times, in
training and scoring alike, which lengthens the matches and not their names.

The toxic dictionary is trained by zstandard on the windows that set toxic texts apart.
A word speaks for toxicity if it, or one of its beginnings of three letters and more, is found in
toxic texts more often than by chance, and at least as often as in ordinary ones. Chance is a bound on
the binomial tail under the toxic texts' share of all words, at a false discovery rate of ``FALSE``
over all words and beginnings, so it holds for few texts and many. A word counts as often as it has
different neighbours or documents, whichever is fewer, so neither copies of a text nor a name
that one text repeats count much. Training windows repeat their word up to ``SAMPLE`` bytes, which keeps
words whole in the trained dictionary; words that the trainer leaves out are put before its content.

Training reads at most ``TRAIN_ROWS`` labelled documents (those with the smallest
hash of their doc_id; rows that repeat a doc_id and text are one document), and ``ORDINARY`` of their
words, drawn by frequency, for each ordinary dictionary; scoring reads every whole text. Distances are kept
per word in a memo of bounded size.

Defined cases: a null or empty text has no windows and is scored like any text
without toxic windows; without labels of both kinds every score is the
share of toxic labels (0 without any); so it is where no word speaks for toxicity (few
labels); a doc_id labelled twice is toxic if one
label says so; null labels are ignored; rows without doc_id are scored but
never trained on or held out; rows repeat as they come. Words beyond ``WINDOW_BYTES`` are several
windows.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, release, written

TRAIN_ROWS = 10_000
#: Words drawn for the training of an ordinary dictionary, and its bytes.
ORDINARY, ORDINARY_BYTES = 20_000, 16_384
#: Ordinary dictionaries, each of its own draws: a window's ordinary length is their mean, so it
#: depends little on which words one of them happens to hold.
SETS = 7
TOXIC_BYTES = 32_768
#: Times that each byte of a window is written, bytes of a training window before that.
REPEAT, SAMPLE = 3, 32
#: Most bytes of a window (a longer word is several).
WINDOW_BYTES = 128
#: Training windows of one word.
COPIES = 8
#: Thresholds on a window's distance whose counts are features of a text: over all windows, and
#: over those that the toxic dictionary covers.
STEPS, COVERED_STEPS = (0.3, 0.5), (0.15, 0.25, 0.35, 0.45, 0.55)
#: Share of the toxic dictionary's own words that count as covered.
COVERED = 0.9
#: False discoveries among words that speak for toxicity.
FALSE = 0.01
#: Least bytes of a beginning, with the space before it.
BEGINNING = 4
CUT = 0.3
#: Contexts that a worker holds at a time, words whose distances it keeps.
CONTEXTS, MEMO = 50_000, 200_000
#: The distance of a window that the first ordinary dictionary describes in no more bytes than the
#: toxic one: most words, which so take two compressions.
NONE = (0.0, False)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, over the whole text; long ones in several."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if words and max(map(len, words)) > WINDOW_BYTES:
        words = [w[i: i + WINDOW_BYTES] for w in words for i in range(0, len(w), WINDOW_BYTES)]
    return words


def window(word: bytes) -> bytes:
    """A word between spaces, each byte ``REPEAT`` times."""
    raw = b" " + word + b" "
    out = bytearray(REPEAT * len(raw))
    for k in range(REPEAT):
        out[k::REPEAT] = raw
    return bytes(out)


def sample(word: bytes) -> bytes:
    """A training window: the word again and again, so that any stretch of it holds the word whole."""
    one = window(word)
    size = max(SAMPLE * REPEAT, len(one))
    return (one * (size // len(one) + 1))[:size]


def beginnings(word: bytes) -> set[bytes]:
    """A word's beginnings with the space before it; the whole word with the space after."""
    w = b" " + word + b" "
    return {w[:n] for n in range(BEGINNING, len(w) + 1)}


@dataclass
class Model:
    ordinary: list[bytes]      # contents of the ordinary dictionaries
    toxic: bytes               # content of the toxic dictionary
    full: int                  # most bytes of a covered window under the toxic dictionary
    weights: list[float]       # of the features; the last one is the constant
    constant: float | None     # the score of every text, where nothing could be learned

    def compressors(self) -> tuple:
        own = zstd.ZstdCompressionParameters.from_level(
            5, strategy=zstd.STRATEGY_BTULTRA, min_match=5, window_log=17, format=zstd.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(content: bytes):
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=own)
            return zstd.ZstdCompressor(dict_data=d, compression_params=own).compress

        return [compressor(c) for c in self.ordinary], compressor(self.toxic)

    def distances(self):
        """A function: word to (distance, whether the toxic dictionary covers it)."""
        plain, toxic = self.compressors()
        memo: dict[bytes, tuple[float, bool]] = {}

        def distance(word: bytes) -> tuple[float, bool]:
            found = memo.get(word)
            if found is None:
                if len(memo) >= MEMO:
                    memo.clear()
                w = window(word)
                b, first = len(toxic(w)), len(plain[0](w))
                found = NONE
                if first > b:
                    a = (first + sum(len(p(w)) for p in plain[1:])) / len(plain)
                    found = ((a - b) / max(1, a - 5), b <= self.full)
                memo[word] = found
            return found

        return distance

    def features(self, text: str | None, distance) -> list[float]:
        words = words_of(text)
        near = [x for x in map(distance, words) if x[0] >= COVERED_STEPS[0]]
        return [max((d for d, _ in near), default=0.0), max((d for d, f in near if f), default=0.0),
                *[math.log1p(sum(d >= s for d, _ in near)) for s in STEPS],
                *[math.log1p(sum(f and d >= s for d, f in near)) for s in COVERED_STEPS],
                math.log1p(len(words)) if near else 0.0, 1.0]  # without evidence a text's length says nothing

    def score(self, text: str | None, distance) -> float:
        if self.constant is not None:
            return self.constant
        z = sum(w * x for w, x in zip(self.weights, self.features(text, distance), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text, y) of the labelled documents to learn from, at most ``TRAIN_ROWS``, none held out."""
    known = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y")).where("_id is not null and _y is not null")
             .where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
             .orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS))
    mine = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    rows = mine.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select(
        "_id", "text", F.col("_y").cast("int").alias("y"), F.xxhash64("_id", "text").alias("_r1"), F.xxhash64(F.lit(7), "text", "_id").alias("_r2"))
    # an id may have any number of texts: the documents are bounded, by their keys
    key = ["_id", "_r1", "_r2"]
    taken = rows.select(*key).distinct().orderBy(F.xxhash64("_id"), *key).limit(TRAIN_ROWS)
    return rows.join(F.broadcast(taken), key, "left_semi").dropDuplicates(key).select(F.col("_r1").alias("doc"), "text", "y")


def _counts(rows: DataFrame) -> DataFrame:
    """(word, t, o): how often toxic and ordinary texts have it, by different
    neighbours or documents, whichever is fewer."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple] = set()
            for doc, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = words_of(text)
                seen.update(zip(own, [b"", *own], [*own[1:], b""], [doc] * len(own), [y] * len(own)))  # noqa: B905  the second list is one longer
                if len(seen) > CONTEXTS:
                    yield _context_batch(seen)
                    seen = set()
            yield _context_batch(seen)
        seen = batch = None
        release()

    each = rows.select("doc", "text", "y").mapInArrow(words, "word binary, around binary, doc long, y int")
    once = each.select("word", "y", F.xxhash64("around").alias("c"), "doc").distinct()
    n = once.groupBy("word", "y").agg(F.countDistinct("c").alias("c"), F.countDistinct("doc").alias("d")).select("word", "y", F.least("c", "d").alias("n"))
    return n.groupBy("word").agg(F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0)).alias("t"),
                                 F.sum(F.when(F.col("y") > 0, 0).otherwise(F.col("n"))).alias("o"))


def _context_batch(seen: set[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([w for w, *_ in seen], pa.binary()), pa.array([a + b" " + b for _, a, b, *_ in seen], pa.binary()),
         pa.array([d for *_, d, _ in seen], pa.int64()), pa.array([y for *_, y in seen], pa.int32())], ["word", "around", "doc", "y"])


def _telling(counts: DataFrame) -> dict[bytes, int]:
    """Words that speak for toxicity, with how often toxic texts have them. The counts
    come from ``TRAIN_ROWS`` documents; only strings more frequent in toxic texts are collected."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t: Counter = Counter()
            o: Counter = Counter()
            for w, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in beginnings(w):
                    t[x] += a
                    o[x] += b
            yield pa.RecordBatch.from_arrays([pa.array(list(t), pa.binary()), pa.array(list(t.values()), pa.int64()),
                                              pa.array([o[x] for x in t], pa.int64())], ["part", "t", "o"])
        t = o = batch = None
        release()

    all_t, all_o = (x or 0 for x in counts.agg(F.sum("t"), F.sum("o")).first())
    parts = written(counts.select("word", "t", "o").mapInArrow(spell, "part binary, t long, o long").groupBy("part").agg(
        F.sum("t").alias("t"), F.sum("o").alias("o")), "toxicity-beginnings")
    m, p0 = parts.count(), all_t / max(1, all_t + all_o)
    if not 0 < p0 < 1:
        return {}
    # Chernoff's bound on the chance that t of t + o fall into toxic texts
    t, n = F.col("t"), F.col("t") + F.col("o")
    q = t / n
    chance = -n * (q * F.log(q / p0) + F.when(F.col("o") > 0, (1 - q) * F.log((1 - q) / (1 - p0))).otherwise(0.0))
    better = parts.where("t >= o and t > 0").withColumn("chance", chance).where(F.col("chance") < math.log(FALSE))
    # Benjamini and Hochberg: the largest rank whose chance is within its share of FALSE
    ranked = better.select("chance").toPandas()["chance"].sort_values().to_numpy()
    within = np.flatnonzero(ranked <= math.log(FALSE) + np.log(np.arange(1, len(ranked) + 1) / m))
    if not len(within):
        return {}
    good = {bytes(r.part) for r in better.where(F.col("chance") <= float(ranked[within[-1]])).select("part").collect()}
    mine = counts.where("t > 0 and t >= o").select("word", "t").toLocalIterator()
    return {bytes(r.word): r.t for r in mine if not good.isdisjoint(beginnings(bytes(r.word)))}


def _trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstd.train_dictionary(size, samples, k=SAMPLE * REPEAT, d=8).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(dict.fromkeys(samples))[:size]


def toxic_content(words: dict[bytes, int]) -> bytes:
    """The content of a dictionary trained on windows of the telling words, each whole in it."""
    order = sorted(words, key=lambda w: hashlib.md5(w).digest())
    content = _trained([sample(w) for copy in range(COPIES) for w in order if words[w] > copy], TOXIC_BYTES)
    missed = [x for x in map(window, sorted(words, key=lambda w: (words[w], w))) if x not in content]
    return b"".join(missed) + content


def ordinary_contents(counts: DataFrame) -> list[bytes]:
    """The contents of ``SETS`` dictionaries trained on ordinary words, drawn as often as they occur."""
    of = counts.where("o > 0")
    total = of.agg(F.sum("o")).first()[0] or 0
    # each word as often as its share of ORDINARY draws, the rest by a hash
    share = F.col("o") * (ORDINARY / max(1, total))
    draws = [F.floor(share + F.pmod(F.xxhash64("word", F.lit(k)), F.lit(1 << 20)) / (1 << 20)).cast("int") for k in range(SETS)]
    drawn = of.select("word", F.array(*draws).alias("n")).where(F.exists("n", lambda n: n > 0)).orderBy(F.xxhash64("word"), "word").limit(2 * SETS * ORDINARY).collect()
    out = []
    for k in range(SETS):
        samples = [sample(bytes(r.word)) for r in drawn for _ in range(r.n[k])]
        random.Random(k).shuffle(samples)
        out.append(_trained(samples, ORDINARY_BYTES))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    """Newton's method with a ridge, on bounded samples."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    prepare(docs.sparkSession)
    rows = written(training_rows(docs, labels, id_col, text_col), "toxicity-rows")
    counts = {r.y > 0: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model([], b"", 0, [], 1.0 if True in counts else 0.0)
    words = written(_counts(rows), "toxicity-words")
    telling = _telling(words)
    if not telling:
        return Model([], b"", 0, [], counts[True] / sum(counts.values()))
    model = Model(ordinary_contents(words), toxic_content(telling), 0, [], None)
    toxic = model.compressors()[1]
    lengths = sorted(len(toxic(window(w))) for w in telling)
    model.full = lengths[int(len(lengths) * COVERED)]

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distance = model.distances()
        for texts in batches:
            yield pd.Series([model.features(t, distance) for t in texts], dtype=object)
        del distance
        release()

    fitted = rows.select(features("text").alias("x"), "y").collect()  # at most TRAIN_ROWS rows of a few numbers
    model.weights = fit_logistic(np.array([r.x for r in fitted]), np.array([float(r.y > 0) for r in fitted]))
    return model


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with each whole text's score, 0 to 1."""
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distance = model.distances() if model.constant is None else None
        for texts in batches:
            yield pd.Series([model.score(t, distance) for t in texts], dtype=float)
        del distance
        release()

    return docs.withColumn(out_col, score(F.col(text_col)))
