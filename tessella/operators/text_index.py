"""Inverted text index: frequencies, postings and statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import columns, dropped, fresh, written

#: Postings of a range partition, about.
PART_ROWS = 1 << 21
#: Places of a term that ``places`` deals together.
RUN = 1 << 16


def document_frequencies(counts: DataFrame) -> DataFrame:
    """``(term, df)``: how many documents have the term. Partial counts are made before the shuffle."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A running number for each term of a sorted partition, and the partition's number."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        term = b.column(0)
        fresh_ = np.r_[term[0].as_py() != last, pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)].astype(bool)
        at = np.arange(len(term))
        begins = np.maximum.accumulate(np.where(fresh_, at, -1))
        k = np.where(begins >= 0, at - begins, at + n)
        last, n = term[-1].as_py(), int(k[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k), pa.array(np.full(len(term), part, np.int32))], [*b.schema.names, "k", "part"])


def postings(counts: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """``(term, pos, doc_id, tf)`` with ``pos`` the document's place, from 0, in the term's list by doc_id.

    The counts are made once and written, then ranged by term and id into parts of about ``rows``, so a term in very many
    documents, or ids of any spread, are numbered by many tasks. Only a part's first term may have begun in earlier parts: its
    shift is one row a part, which bounds the broadcast. Rows without an id or a term have no place and are left out; equal
    ids keep a place each, by count. A term may be of any type that has an order, such as the number of a visual word.
    """
    kinds = dict(counts.dtypes)
    staged = written(counts.where(F.col("doc_id").isNotNull() & F.col("term").isNotNull()).select("term", "doc_id", "tf"), "counts")
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), staged.count() // rows + 1)
    ranged = staged.repartitionByRange(parts, "term", "doc_id", "tf").sortWithinPartitions("term", "doc_id", "tf")
    schema = f"term {kinds['term']}, doc_id {kinds['doc_id']}, tf {kinds['tf']}, k long, part int"
    made = written(ranged.mapInArrow(_numbered, schema), "postings")
    dropped(staged)
    ends = made.groupBy("part").agg(F.min("term").alias("first"), F.max(F.struct("term", "k")).alias("end"))
    so_far = Window.partitionBy("end.term").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select("part", "first", F.col("end.term").alias("last"), F.sum(F.col("end.k") + 1).over(so_far).alias("n"))
    order = Window.orderBy("part")
    goes_on = F.lag("last").over(order) == F.col("first")
    shifts = ends.select("part", "first", F.when(goes_on, F.lag("n").over(order)).otherwise(F.lit(0)).alias("shift"))
    shift = F.when(F.col("term") == F.col("first"), F.col("shift")).otherwise(F.lit(0))
    return made.join(F.broadcast(shifts), "part").select("term", (F.col("k") + shift).alias("pos"), "doc_id", "tf")


def places(counts: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """``(term, pos)`` of every posting, for what needs no document of it: the rows of ``postings``, by the same rules.

    A term's places are 0 to its number of postings less one, so that number is all that is shuffled. Runs of places are dealt to
    parts of about ``rows``, and a term in very many documents to many of them.
    """
    known = counts.where(F.col("doc_id").isNotNull() & F.col("term").isNotNull())
    staged = written(document_frequencies(known), "frequencies")
    total = staged.agg(F.sum("df").alias("n")).first().n or 0
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // rows + 1)
    begins = F.sequence(F.lit(0).cast("long"), F.col("df") - 1, F.lit(RUN).cast("long"))
    runs = staged.select("term", "df", F.explode(begins).alias("begin")).repartition(parts, "term", "begin")
    return runs.select("term", F.explode(F.sequence("begin", F.least(F.col("begin") + RUN, "df") - 1)).alias("pos"))


def collection_size(docs: DataFrame) -> Column:
    """Number of documents as a scalar subquery: part of the plan, not a job of its own."""
    return docs.agg(F.count(F.lit(1)).alias("n")).scalar()


def index_size(counts: DataFrame) -> DataFrame:
    """Number of stored postings."""
    return counts.agg(F.count(F.lit(1)).alias("index_size"))


def words_by_frequency(counts: DataFrame) -> DataFrame:
    """All terms by ascending document frequency, ties by term."""
    return document_frequencies(counts).orderBy("df", "term")


def documents_without_terms(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents that the index has no posting of; they still belong to the universe of NOT."""
    return docs.select("doc_id").join(counts.select("doc_id"), "doc_id", "left_anti")


def document_lengths(counts: DataFrame) -> DataFrame:
    """Tokens kept of each document that has any."""
    return counts.groupBy("doc_id").agg(F.sum("tf").cast("long").alias("n_tokens"))


def labels_needed(counts: DataFrame, occurrences: dict[str, int]) -> DataFrame:
    """Postings that a query fetches: document frequencies summed over its word occurrences."""
    named = counts.where(F.col("term").isin(*occurrences))
    times = F.create_map(*[x for t, n in occurrences.items() for x in (F.lit(t), F.lit(n))])
    total = F.coalesce(F.sum(times[F.col("term")]), F.lit(0)).cast("long")
    return named.agg(total.alias("labels_needed"))


def dense_ids(df: DataFrame, *order: Column, start: int = 0, name: str = "doc_id") -> DataFrame:
    """Number rows from ``start`` in an order, without taking all rows through one task.

    Rows are range partitioned, sorted, and written once with their partition and place. Counts and numbers both come
    from that table, so they agree whatever bounds were drawn. Equal rows are numbered in any one order. The counts are as
    many as there are partitions, which bounds the broadcast. A column called ``name`` is replaced.
    """
    df = df.drop(name)
    at, part, shift = (fresh(df, c) for c in ("_at", "_part", "_shift"))
    place = F.monotonically_increasing_id()
    staged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, place), "numbered")
    cut = staged.withColumn(part, F.shiftright(at, 33))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    shifts = sizes.select(part, (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.lit(start)).alias(shift))
    within = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    numbered = cut.join(F.broadcast(shifts), part).withColumn(name, (F.col(shift) + within).cast("long"))
    return numbered.select(*columns(df), name)
