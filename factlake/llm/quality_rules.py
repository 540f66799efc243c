"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback is measured on every text: characters
per token, the share of byte-fallback tokens, and the entropy of the tokens
in bits. Text that is not ordinary prose in its language stands out: shouting
and symbol tails have few characters per token, repetition has low entropy,
noise has many byte tokens. Bands are per language (per script where the
language is null), learned from all rows: entropy is first freed of its growth
with length (the median of all texts whose token count has the same power of
two is taken off), then each metric's median and median absolute deviation are
taken per language, and a text outside ``BANDS`` deviations is rejected. Medians
come from counts per bin (bins of ``BIN``), so no group is gathered and every
row counts; junk of up to half of a language's texts does not move them much.

Base rules come first: too few words, or too many words in repeated
three-word windows. They hold whatever the bands say.

Defined cases: a null or empty text has no words and fails the base rules;
null languages go by script; repeated rows are rows of their own; an empty
table gives no rows; a language with a deviation of zero has a band of ``FLOOR``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import heavy_join, prepare, written

SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\x0b\x0c\r"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Least and most robust deviations from the language's median, by metric.
BANDS = {"chars_per_token": (-6.0, 10.0), "byte_share": (-1e9, 10.0), "entropy": (-3.25, 8.0)}
#: Width of the bins that medians are read from, and the least deviation of a band.
BIN, FLOOR = {"chars_per_token": 1e-3, "byte_share": 1e-4, "entropy": 1e-3}, {"chars_per_token": 0.02, "byte_share": 1e-3, "entropy": 0.02}
MEMO = 400_000
BLOCK = 1 << 16

METRICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "n_tokens long, chars_per_token double, byte_share double, entropy double, script string")


class Vocabulary(dict):
    """Word to the ids of its pieces (16 or 32 bits each), worked out by the
    library where missing; starts anew when full."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in set(words) if w not in self]
        if len(self) + len(new) > MEMO:
            self.clear()
            new = list(set(words))
        for at in range(0, len(new), 4096):
            part = new[at: at + 4096]
            for w, ids in zip(part, self.model.encode([w.decode("utf-8", "replace") for w in part], num_threads=1), strict=True):
                self[w] = np.array(ids, "<u4").tobytes()


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def repeated_words(codes: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more, the first included."""
    if len(codes) < 4:
        return 0
    base = int(codes.max()) + 1
    if base ** 3 < 2 ** 62:
        keys = (codes[:-2] * base + codes[1:-1]) * base + codes[2:]
    else:  # pairs first, so that the keys fit into 64 bits
        _, pairs = np.unique(codes[:-2] * base + codes[1:-1], return_inverse=True)
        keys = pairs * base + codes[2:]
    _, window, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k: k + len(again)] |= again
    return int(covered.sum())


#: Beginnings of the ranges that tell scripts apart, by code point.
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"),
           (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
           (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0x20000, "han"))
_SCRIPT_AT = np.array([a for a, _ in SCRIPTS])


def script_of(text: str) -> str:
    """The script of most code points from U+0041 on, punctuation aside."""
    if text.isascii():
        return "latin"
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    at = np.bincount(np.searchsorted(_SCRIPT_AT, codes[codes >= 0x41], "right") - 1, minlength=len(SCRIPTS))
    names: dict[str, int] = {}
    for n, (_, name) in zip(at.tolist(), SCRIPTS, strict=True):
        names[name] = names.get(name, 0) + n
    return max(sorted(names), key=names.__getitem__)


def measure(text: str | None, vocab: Vocabulary) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += bool(line.strip(GAPS))
            else:
                seen.add(line)
    vocab.learn(list(number))
    counts = np.zeros(vocab.size, np.int64)
    for at in range(0, len(words), BLOCK):
        part = words[at: at + BLOCK]
        try:
            raw = b"".join(map(vocab.__getitem__, part))
        except KeyError:  # the memo started anew in between
            vocab.learn(part)
            raw = b"".join(map(vocab.__getitem__, part))
        counts += np.bincount(np.frombuffer(raw, "<u4"), minlength=vocab.size)
    chars = len(text) - sum(map(text.count, GAPS))
    used = counts[counts > 0]
    n = int(used.sum())
    share = used / n if n else used
    return (len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(codes), n,
            chars / n if n else None, float(counts[vocab.is_byte].sum() / n) if n else None,
            float(-(share * np.log2(share)).sum()) if n else None, script_of(text))


def metrics(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "m") -> DataFrame:
    """``docs`` with a struct of what the rules count in each whole text."""
    prepare(docs.sparkSession)

    @F.pandas_udf(METRICS)
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(model_path)
        names = [x.split()[0] for x in METRICS.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measure(t, vocab) for t in texts], columns=names)

    return docs.withColumn(out_col, counted(F.col(text_col)))


def medians(rows: DataFrame, by: str, value: Column, width: float, name: str) -> DataFrame:
    """(by, name, n): the lower median of ``value`` in bins, per group."""
    bins = rows.where(value.isNotNull()).groupBy(by, F.round(value / width).cast("long").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    # a group has as many rows here as it has bins
    w = Window.partitionBy(by).orderBy("_bin")
    ranked = bins.withColumn("_up", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(by)))
    return (ranked.where(F.col("_up") * 2 >= F.col("_all")).groupBy(by)
            .agg((F.min("_bin") * width).alias(name), F.first("_all").alias("n")))


def verdicts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the counts, the metrics, each metric's deviation (``z_...``),
    base_failed and kept; one row per input row."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    rows = metrics(slim, model_path, "_text").select("_id", "_lang", "m.*")
    rows = rows.withColumn("_group", F.coalesce(F.concat(F.lit("lang:"), "_lang"), F.concat(F.lit("script:"), "script"))).withColumn(
        "_size", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    rows = written(rows, "quality-metrics")
    # what a text's length explains; a row for each power of two, 63 at most
    usual = medians(rows, "_size", F.col("entropy"), BIN["entropy"], "_usual").select("_size", "_usual")
    rows = rows.join(F.broadcast(usual), "_size", "left").withColumn("_entropy", F.col("entropy") - F.col("_usual"))
    # bands from the texts long enough to be judged
    judged = rows.where(F.col("n_words") >= MIN_WORDS)
    for name in BANDS:
        value = F.col("_entropy" if name == "entropy" else name)
        mid = medians(judged, "_group", value, BIN[name], "_mid")
        near = heavy_join(judged.select("_id", "_group", value.alias("_v")), mid, ["_group"], "n", F.xxhash64("_id", "_v"))
        dev = medians(near, "_group", F.abs(F.col("_v") - F.col("_mid")), BIN[name], "_dev").drop("n")
        band = mid.join(dev.withColumnRenamed("_group", "_g"), F.col("_group") == F.col("_g")).select(
            "_group", F.col("_mid").alias(f"_mid_{name}"), F.greatest(F.col("_dev") * 1.4826, F.lit(FLOOR[name])).alias(f"_dev_{name}"), "n")
        rows = heavy_join(rows, band, ["_group"], "n", F.xxhash64("_id", "n_tokens", "entropy")).withColumn(
            f"z_{name}", (value - F.col(f"_mid_{name}")) / F.col(f"_dev_{name}"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    within = F.lit(True)
    for name, (low, high) in BANDS.items():
        within = within & F.coalesce(F.col(f"z_{name}").between(low, high), F.lit(True))
    return rows.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "n_tokens", "chars_per_token", "byte_share", "entropy", *[f"z_{n}" for n in BANDS],
                       failed.alias("base_failed"), (~failed & within).alias("kept"))
