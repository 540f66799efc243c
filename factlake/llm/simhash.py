"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint is the bitwise majority of the hashes of its shingles.
To link all fingerprints that differ in at most ``radius`` bits, every
distinct fingerprint emits all variants within half the radius (one bit:
itself and its 64 single flips) and is shuffled on them. Two fingerprints
within the radius share a variant, and each variant's group holds at most
65 distinct fingerprints, however many documents there are: copies share
one fingerprint and are merged before the shuffle. A group is linked as a
star to its smallest member (pairs that share a variant at distance one are
within the radius; each link is verified), which keeps its connectedness
without emitting all pairs. Components of the links come from alternating
large-star and small-star rounds, each cut by a checkpoint.

Defined cases: a null or empty text, or one of white space only, has
fingerprint zero and is linked like any other; fewer words than a shingle make
one shingle; repeated shingles count as often as they occur; a row with a null
doc_id joins its component but never names it (a component of null ids only
has a null component_id); rows that repeat a doc_id each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, heavy_join, prepare, written
from .decontaminate import _key

SHINGLE = 3
RADIUS = 2
SEED = 42

# Shingles hashed and counted at a time: bounds the memory of a very long text.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower: A-Z only
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    begin, end = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    counts, total, digest = np.zeros(64, np.int64), len(begin), xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[at: at + BLOCK], end[at: at + BLOCK])],
                     dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str, out_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit column."""

    @F.pandas_udf("long")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out_col, signed(F.col(text_col)))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a < b) between distinct fingerprints ``fp`` that keep every
    component of the relation "differ in at most ``radius`` bits"."""
    if radius not in (0, 1, 2):
        raise ValueError("balls of half the radius are built for radii up to 2")
    if radius == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    flips = [F.lit(0).cast("long"), *[F.lit(v if v < 2**63 else v - 2**64).cast("long") for v in (1 << i for i in range(64))]]
    balls = fps.select("fp", F.explode(F.array(*flips)).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    # at most 65 distinct members in a ball of radius one
    groups = balls.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    if radius == 1:  # the star's leaves may be two apart: link through the variant itself
        star = balls.where("fp <> variant").select(F.least("fp", "variant").alias("a"), F.greatest("fp", "variant").alias("b"))
        star = star.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        return star.select("a", "b")
    return star.where(near).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest
    node of its component. Large-star and small-star rounds until the edges
    are stars; no round gathers a node's neighbours."""

    def smallest(directed: DataFrame) -> DataFrame:
        return directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("w"))

    def told(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.select("a", "b").distinct())
    state = told(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = heavy_join(both, smallest(both), ["u"], "w", F.col("v"), how="inner").where("v > u and m <> v")
        edges = cut(large.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # each node to its smaller neighbours
        small = heavy_join(down, smallest(down), ["u"], "w", F.col("v"), how="inner")
        edges = cut(small.select(F.col("m").alias("a"), "u").union(small.select(F.col("m").alias("a"), F.col("v").alias("u")))
                    .where("a <> u").distinct().select("a", F.col("u").alias("b")))
        state, before = told(edges), state
        if state == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).groupBy("node").agg(F.min("root").alias("root"))


def component_ids(prints: DataFrame, id_col: str, radius: int = RADIUS) -> DataFrame:
    """(fp, n, component_id) for each distinct ``fp`` of ``prints`` (id, fp)."""
    fps = cut(prints.groupBy("fp").agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("n")))
    roots = components(links(fps.select("fp"), radius))
    tied = fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    tied = cut(tied)
    names = tied.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("w"))
    return heavy_join(tied.select("fp", "n", "root"), names, ["root"], "w", F.col("fp")).select("fp", "n", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed fingerprint), component_id; one row per input row."""
    prepare(docs.sparkSession)
    prints = written(with_fingerprint(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", "fp", shingle)
                     .select("_id", "fp"), "fingerprints")
    named = component_ids(prints, "_id", radius)
    return heavy_join(prints, named, ["fp"], "n", F.col("_id")).select(F.col("_id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The input's rows whose doc_id names their component: one document of
    each group. Rows without a doc_id stay; of rows that repeat the naming
    doc_id all stay that are in its component. A row goes by its doc_id and
    text, so a doc_id that two texts have may go in one component and stay in
    another."""
    prepare(docs.sparkSession)
    gone_id, r1, r2 = fresh(docs, "gone_id"), fresh(docs, "r1"), fresh(docs, "r2")
    prints = written(with_fingerprint(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *_key(id_col, text_col)),
                                      "_text", "fp", shingle).select("_id", "_r1", "_r2", "fp"), "fingerprints")
    named = component_ids(prints, "_id", radius)
    gone = heavy_join(prints, named, ["fp"], "n", F.col("_id")).where("_id <> component_id").select(
        F.col("_id").alias(gone_id), F.col("_r1").alias(r1), F.col("_r2").alias(r2)).distinct()
    k1, k2 = _key(id_col, text_col)
    return docs.join(gone, (docs[id_col] == F.col(gone_id)) & (k1 == F.col(r1)) & (k2 == F.col(r2)), "left_anti")
