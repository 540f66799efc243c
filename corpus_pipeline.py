"""The corpus pipeline: a list of stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result to the shared folder and gives what it reads back to the
next one. All stages but the last return the columns of documents. A null
text counts as empty; empty tables pass through; repeated rows are rows; other
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from factlake.llm.common import fresh, table, written
from factlake.llm.queries import TOKENIZER


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity cut stay. The model is trained on
    the labelled ones among ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return toxicity.with_score(docs, model, out_col=score).where(F.col(score) < toxicity.CUT).drop(score)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents have are taken out of all texts."""
    return line_dedup.drop_shared_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the smallest doc_id."""
    return simhash.keep_one(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of each text's ids and decoded text."""
    return bpe.round_trip(docs, TOKENIZER)


STAGES = [
    ("toxicity", ordinary),
    ("line_dedup", shared_lines),
    ("simhash", near_copies),
    ("decontaminate", untested),
    ("bpe", tokens),
]

#: Toxicity scores come from zstandard, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage applied to the documents table in turn."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
