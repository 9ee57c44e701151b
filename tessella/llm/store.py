"""Texts in tasks: bounded batches and slices; tables between steps come from the library's staging module."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..staging import columns, dropped, fresh, shared_folder, written  # noqa: F401

#: Bytes of Arrow data handed to a Python worker at once, and of text that is worked on at once.
BATCH_BYTES = 8 << 20
SLICE_BYTES = 1 << 19


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once by bytes, so long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its texts in them. Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of text; a longer text is alone."""
    for b in batches:
        if not b.num_rows:
            continue
        _, at = text_bytes(b.column(text))
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + SLICE_BYTES, "right")) - 1)
            yield b.slice(start, end - start)
            start = end


def map_texts(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: int) -> DataFrame:
    """mapInArrow over slices of rows; ``text`` is the place of the text column."""
    bounded_batches(df.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            out = run(b)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(go, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type that a column reaches Python with, whatever its type."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
