"""Line dedup: lines that many documents share go, everywhere.

DataFrame functions only. Every text is exploded into normalised lines, each
line is hashed (two 64-bit hashes with different seeds, 128 bits together),
the documents of each hash are counted with map-side combining, and the
positions of the lines over the threshold are gathered per document. Texts
themselves are shuffled once, by row key, to meet their positions.

Defined cases: a null or empty text is one empty line; every row is a document
of its own, also when doc_ids are null or repeat; a line that a document
repeats counts once for it; lines whose key is empty are never dropped; other
columns of the input are ignored by ``dropped_lines`` and kept by
``drop_shared_lines``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, heavy_join

# Stripped at both ends of a line: space, and 9 to 13.
GAP = " \t\n\x0b\x0c\r"

MIN_CHARS = 1
MIN_DOCS = 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(GAP)))


def _row_key(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Rows that agree on this key have the same lines and so the same result."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("_r1"),
            F.xxhash64(F.lit(7), F.col(text_col), F.col(id_col)).alias("_r2")]


def shared_lines(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n_docs) of every line key that at least ``min_docs`` rows have."""
    keys = F.transform(lines_of(F.col(text_col)), line_key)
    pairs = F.transform(F.filter(keys, lambda k: F.char_length(k) >= min_chars),
                        lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")))
    once = docs.select(F.explode(F.array_distinct(pairs)).alias("k"))
    return (once.groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
            .agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs))


def dropped_positions(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(_r1, _r2, _dropped): the sorted positions of the lines to drop, for
    the rows that lose any."""
    lines = (docs.select(*_row_key(docs, id_col, text_col),
                         F.posexplode(lines_of(F.col(text_col))).alias("_pos", "_line"))
             .withColumn("_key", line_key(F.col("_line")))
             .where(F.char_length("_key") >= min_chars)
             .select("_r1", "_r2", "_pos", F.xxhash64("_key").alias("h1"),
                     F.xxhash64(F.lit(1), F.col("_key")).alias("h2")))
    hits = heavy_join(lines, shared_lines(docs, text_col, min_chars, min_docs), ["h1", "h2"], "n_docs",
                      F.xxhash64("_r1", "_pos"), how="left_semi")
    return hits.groupBy("_r1", "_r2").agg(F.array_sort(F.collect_set("_pos")).alias("_dropped"))


def _with_kept(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    gone = dropped_positions(docs, id_col, text_col, min_chars, min_docs)
    out = (docs.withColumns({c: e for c, e in zip(("_r1", "_r2"), _row_key(docs, id_col, text_col), strict=True)})
           .join(gone, ["_r1", "_r2"], "left")
           .withColumn("_lines", lines_of(F.col(text_col)))
           .withColumn("_n", F.size("_lines")))
    # positions kept: a hash-based difference, linear in the number of lines
    keep = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), F.col("_dropped"))
    return (out.withColumn("_keep", F.when(F.col("_dropped").isNotNull(), keep))
            .withColumn("_kept", F.when(F.col("_dropped").isNull(), F.coalesce(F.col(text_col), F.lit("")))
                        .otherwise(F.array_join(F.transform("_keep", lambda i: F.get(F.col("_lines"), i)), "\n"))))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text, one row per input row."""
    slim = docs.select(id_col, text_col)
    out = _with_kept(slim, id_col, text_col, min_chars, min_docs)
    return out.select(id_col, F.col("_n").cast("long").alias("n_lines"),
                      F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.col("_kept").alias("kept"))


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The input with its texts freed of shared lines; all columns and rows stay."""
    row = fresh(docs, "row")
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct("*").alias(row))
    out = _with_kept(slim, "_id", "_text", min_chars, min_docs)
    return out.select(*[F.col("_kept").alias(c) if c == text_col else F.col(row)[c].alias(c)
                        for c in docs.columns])
