"""Positions of postings given out as documents arrive: a counter for each term, block of ids and batch.

A counter belongs to a term and a block of document ids, so a term that is in every document is counted by many tasks.
A posting's place within its block and batch is fixed when it arrives; a term's blocks, and a block's batches, are put one after
the other by the counts of the earlier ones. Batches are numbered tables, and their rows are the counters' state: one that is
replayed after a failure writes the same places over the same table, and a restart needs nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X

#: Ids of a block; a task holds at most so many postings of a term at once.
BLOCK = 1 << 16
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "term string, block long, place long, doc_id long, tf int"


def block_of(doc_id: Column) -> Column:
    return F.floor(doc_id / F.lit(BLOCK)).cast("long")


def placed(counts: DataFrame) -> DataFrame:
    """``(term, block, place, doc_id, tf)`` of a batch of ``(doc_id, term, tf)``. Null ids have no place and are left out."""
    known = counts.where(F.col("doc_id").isNotNull()).withColumn("block", block_of(F.col("doc_id")))
    order = Window.partitionBy("term", "block").orderBy("doc_id", "tf")
    return known.select("term", "block", (F.row_number().over(order) - 1).cast("long").alias("place"), "doc_id", "tf")


def ingest_positions(stream: DataFrame, path: str, checkpoint: str, stop_words=(), available_now: bool = False) -> StreamingQuery:
    """Write placed postings of a stream of documents ``(doc_id, text)`` under ``path``, a folder for each micro-batch.

    A query that starts at ``checkpoint`` again goes on with the next batch. Document ids must be new.
    """
    counts = X.term_counts(stream, stop_words)
    writer = counts.writeStream.foreachBatch(lambda b, n: placed(b).write.mode("overwrite").parquet(f"{path}/batch={n}"))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """``(term, pos, doc_id, tf)`` of all that has arrived, positions from 0 in each term's list."""
    rows = spark.read.schema(f"{SCHEMA}, batch long").parquet(path)
    own = ["term", "block", "batch"]
    sizes = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("term").orderBy("block", "batch").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*own, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    return rows.join(shifts, own).select("term", (F.col("place") + F.col("shift")).alias("pos"), "doc_id", "tf")
