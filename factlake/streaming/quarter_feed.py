"""Incremental pick-up of newly landed quarter folders.

The published data arrives as one folder per quarter. A Structured
Streaming file source over the quarters' ``sub`` files notices new folders;
each micro-batch loads exactly the quarters it saw with the batch load job
(``ingest_quarters``), which is idempotent, so a batch retried after a
failure gives the same lake. The stream's checkpoint (a shared folder)
records which files were handled, so every quarter is loaded once. A quarter
whose other files have not landed yet fails its batch after the complete ones
are loaded; the batch is run again when the stream is started next.

Only the file *paths* are read (binary-file source, content column not
selected); the set of quarter labels in a batch is tiny (one per folder).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from factlake.plans.ingest import ingest_quarters
from factlake.sources.tsv import DEFAULT_LAYOUT, missing_inputs, quarter_of_path


BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])


class IncompleteQuarter(RuntimeError):
    """A quarter's other files have not landed yet."""


def _sub_glob(raw_dir: str, layout: str) -> str:
    path = layout.format(raw=raw_dir.rstrip("/"), quarter="*", table="sub")
    return path if path.endswith(".txt") else path + "/*"


def watch_quarters(spark: SparkSession, raw_dir: str, lake_dir: str, checkpoint: str,
                   layout: str = DEFAULT_LAYOUT, available_now: bool = True,
                   interval: str = "10 minutes") -> StreamingQuery:
    """Start the pick-up stream; with ``available_now`` it loads whatever is
    new and stops (run it on a schedule), else it polls every ``interval``."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .load(_sub_glob(raw_dir, layout))
             .select(quarter_of_path("path").alias("quarter")))

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        quarters = sorted(r["quarter"] for r in batch.select("quarter").distinct().collect()
                          if r["quarter"])
        if not quarters:
            return
        waiting = {q: m for q in quarters if (m := missing_inputs(spark, raw_dir, q, layout))}
        ready = [q for q in quarters if q not in waiting]
        if ready:
            ingest_quarters(spark, raw_dir, lake_dir, ready, layout=layout)
        if waiting:  # the batch is not committed, so the next run sees these quarters again
            raise IncompleteQuarter("; ".join(f"{q} lacks {', '.join(m)}" for q, m in waiting.items()))

    writer = files.writeStream.foreachBatch(load_batch).option("checkpointLocation", checkpoint)
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=interval))
    return writer.start()


def pending_quarters(spark: SparkSession, raw_dir: str, lake_dir: str,
                     layout: str = DEFAULT_LAYOUT) -> DataFrame:
    """Quarter folders present in ``raw_dir`` but absent from the current lake
    snapshot (a batch view of what the stream would pick up)."""
    from factlake.sources.lake import current_snapshot, read_table

    landed = (spark.read.format("binaryFile").load(_sub_glob(raw_dir, layout))
              .select(quarter_of_path("path").alias("quarter")).distinct())
    snap = current_snapshot(spark, lake_dir)
    if snap is None:
        return landed
    loaded = read_table(spark, lake_dir, "sub", snap).select("quarter").distinct()
    return landed.join(loaded, "quarter", "left_anti")
