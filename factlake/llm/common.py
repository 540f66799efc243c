"""Helpers shared by the operators: words, shared folders, skew-proof joins."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.session import apply_plan_confs, ensure_checkpoint_dir

# White space that separates words, in every operator whose contract says so:
# exactly the bytes on which ``bytes.split()`` splits.
WORD_GAP = "[\\x20\\x09-\\x0D]+"

# Rows named as heavy in ``heavy_join``. A key outside this many heaviest keys
# holds less than 1/1024 of the rows, and the broadcast side has at most this
# many rows whatever the size of the input.
HEAVY_KEYS = 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: the library's plan settings,
    and Arrow batches bounded by bytes, so that very long texts do not make
    a batch of ten thousand rows outgrow a worker."""
    apply_plan_confs(spark)
    # Python workers on this machine find the library wherever they start; on
    # other machines it is installed or shipped (--py-files)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), root)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, what: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: a result that
    is used more than once, or that names files its tasks have written."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give back to the system what a Python worker's task has freed. Workers
    stay for later tasks; what they hold counts beside the stages that run in
    the JVM alone."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (in any letter case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else. ``lower`` does that on pure ASCII (byte count
    = character count) and is much cheaper than ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def heavy_join(left: DataFrame, right: DataFrame, on: list[str], weight: str,
               spread: Column, how: str = "left", heavy: int = HEAVY_KEYS) -> DataFrame:
    """Equi-join of ``left`` with ``right`` that no key can skew.

    ``right`` has one row per key, non-null keys, and ``weight``: how many rows
    of ``left`` the key has. Its ``heavy`` heaviest rows are broadcast (a
    bound that does not depend on the input's size); the other keys, each
    under 1/heavy of the rows, meet in a shuffle join, in which the rows
    already matched are dealt by ``spread`` (a column of ``left`` that differs
    between rows) and match nothing. ``how``: left, inner or left_semi.
    Columns of ``right`` other than its key must not occur in ``left``;
    ``weight`` is not returned.
    """
    values = [c for c in right.columns if c not in on and c != weight]
    hot = right.orderBy(F.desc(weight), *on).limit(heavy).select(
        *[F.col(c).alias(f"_hk_{c}") for c in on], F.struct(F.lit(1).alias("_one"), *values).alias("_hot"))
    keys = [F.col(c) == F.col(f"_hk_{c}") for c in on]
    marked = left.withColumn("_spread", spread).join(F.broadcast(hot), keys, "left").drop(
        *[f"_hk_{c}" for c in on])
    # the key's hash, or for rows already matched one that matches nothing (if
    # it should, it finds the same row of ``right`` again)
    marked = marked.withColumn("_deal", F.when(F.col("_hot").isNull(), F.xxhash64(*on)).otherwise(F.xxhash64("_spread")))
    cold = right.select(*[F.col(c).alias(f"_ck_{c}") for c in on], F.xxhash64(*on).alias("_ck_deal"),
                        F.struct(F.lit(1).alias("_one"), *values).alias("_cold"))
    out = marked.join(cold, [F.col("_deal") == F.col("_ck_deal")]
                      + [F.col(c) == F.col(f"_ck_{c}") for c in on], "left")
    found = F.coalesce("_hot", "_cold")
    if how in ("inner", "left_semi"):
        out = out.where(found.isNotNull())
    take = [] if how == "left_semi" else [found[v].alias(v) for v in values]
    return out.select(*left.columns, *take)


def open_store(uri: str):
    """(file system, path) of a path or URI, for files that tasks write and
    read themselves. Hadoop prints local folders as ``file:/...``."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
