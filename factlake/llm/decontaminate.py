"""Benchmark decontamination: short test items found inside long documents.

DataFrame functions only. Containment, not similarity, is what counts: the
share of a test item's five-word shingles that a document has. A MinHash
signature of a whole long document says next to nothing about a short item in
it, so the sketch is the item's: the smallest hashes of its shingles, as many
as its size asks for. A document that has at least ``need`` of an item's n
shingles has one of any n - need + 1 of them, so the search misses nothing.
Items are partitioned by size; each partition has a cut, the largest hash in
its sketches, and a least number of shingles that a document must have. A
document's shingles are looked up only up to the largest cut of the partitions
that its own size can contain.

The pairs found are verified by exact containment: the shingles themselves, as
words, of the documents found. Sketches and pairs are written tables, so the
planner knows their size and broadcasts them only below its threshold.

Words are runs of letters and digits, in lower case. A text of fewer words than
a shingle is one shingle; without words it has none and matches nothing.
Defined cases: null texts have no words; rows that repeat an item's id and text
are one item, rows that repeat a document's id and text are one document; a
null doc_id or item_id stays null in the result; extra columns are ignored by
``contaminated`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, prepare, written

SHINGLE = 5
CONTAINMENT = 0.8


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias("_r1"), F.xxhash64(F.lit(7), F.col(text_col), F.col(id_col)).alias("_r2")]


def _shingles(rows: DataFrame, keep: list[str], shingle: int) -> DataFrame:
    """A row for each shingle of ``_words``, as its place ``_i``; none without words."""
    n = F.size("_words")
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))))
    return rows.select(*keep, "_words", F.explode(places).alias("_i"))


def _hash(shingle: int) -> Column:
    # words past the end are null, which the hash passes over
    return F.xxhash64(*[F.get(F.col("_words"), F.col("_i") + k) for k in range(shingle)])


def _text(shingle: int) -> Column:
    return F.concat_ws(" ", *[F.get(F.col("_words"), F.col("_i") + k) for k in range(shingle)])


def item_shingles(items: DataFrame, id_col: str, text_col: str, shingle: int, share: float) -> DataFrame:
    """(_item, item_id, h, s, n, need, rank): each item's distinct shingles by
    rising hash, with their number and how many a document must have."""
    rows = items.select(F.col(id_col).alias("item_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_item"),
                        words_of(F.col(text_col)).alias("_words"))
    each = _shingles(rows, ["item_id", "_item"], shingle).select(
        "item_id", "_item", _hash(shingle).alias("h"), _text(shingle).alias("s")).distinct()
    own = Window.partitionBy("_item")  # as many rows as the item has shingles
    counted = each.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("h", "s")))
    return counted.withColumn("need", F.ceil(F.col("n") * share - 1e-9).cast("long"))


def contaminated_keys(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE,
                      share: float = CONTAINMENT) -> DataFrame:
    """(_r1, _r2, doc_id, item_id, n_shared, n_shingles) of every document and item
    whose containment is at least ``share``."""
    prepare(docs.sparkSession)
    item = written(item_shingles(items, item_col, item_text_col, shingle, share), "items")
    sketch = written(item.where(F.col("rank") <= F.col("n") - F.col("need") + 1)
                     .withColumn("part", F.floor(F.log2("n")).cast("int")), "sketches")
    # a row for each power of two
    parts = sketch.groupBy("part").agg(F.min("need").alias("need"), F.max("h").alias("cut")).orderBy("need").collect()
    # the cut for a document of so many shingles: of all partitions it can contain
    size, cut = F.size("_words") - (shingle - 1), F.lit(None).cast("long")
    for k in range(len(parts)):
        cut = F.when(F.greatest(size, F.lit(1)) >= parts[k].need, F.lit(max(p.cut for p in parts[: k + 1])).cast("long")).otherwise(cut)
    rows = docs.select(F.col(id_col).alias("_id"), *_key(id_col, text_col), words_of(F.col(text_col)).alias("_words"))
    probes = (_shingles(rows.withColumn("_cut", cut).where("_cut is not null"), ["_r1", "_r2", "_cut"], shingle)
              .withColumn("_h", _hash(shingle)).where("_h <= _cut")
              .withColumn("_size", F.greatest(size, F.lit(1))))
    found = (probes.join(sketch.select("h", "_item", "need"), (F.col("_h") == F.col("h")) & (F.col("_size") >= F.col("need")))
             .select("_r1", "_r2", "_item").distinct())
    pairs = written(found, "candidates")
    # verify: the candidates' shingles as words
    each = _shingles(rows.join(pairs.select("_r1", "_r2").distinct(), ["_r1", "_r2"], "left_semi"), ["_r1", "_r2", "_id"], shingle)
    # the hash only narrows down; the words decide
    held = each.select("_r1", "_r2", "_id", _hash(shingle).alias("h"), _text(shingle).alias("s")).join(
        item.select("_item", "item_id", "h", "s", "n", "need"), ["h", "s"])
    shared = held.groupBy("_r1", "_r2", "_id", "_item", "item_id", "n", "need").agg(F.countDistinct("s").alias("n_shared"))
    return shared.join(pairs, ["_r1", "_r2", "_item"], "left_semi").where("n_shared >= need").select(
        "_r1", "_r2", F.col("_id").alias("doc_id"), "item_id", "n_shared", F.col("n").alias("n_shingles"))


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment: a row per pair."""
    out = contaminated_keys(docs, items, **options)
    return out.select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input without the documents that contain an item."""
    keys = contaminated_keys(docs, items, id_col=id_col, text_col=text_col, **options).select("_r1", "_r2").distinct()
    r1, r2 = fresh(docs, "r1"), fresh(docs, "r2")
    bad = written(keys.select(F.col("_r1").alias(r1), F.col("_r2").alias(r2)), "contaminated")
    k1, k2 = _key(id_col, text_col)
    return docs.join(bad, (k1 == F.col(r1)) & (k2 == F.col(r2)), "left_anti")
