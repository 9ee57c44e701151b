"""Structured Streaming into the indexes: each micro-batch is one numbered, repeatable add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import ImageIndex, TextIndex
from ..operators.codebooks import SequentialKMeans


def _start(stream: DataFrame, add, checkpoint: str, available_now: bool) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            add(batch, number + 1)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_texts(stream: DataFrame, index: TextIndex, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append documents as they come. A batch replayed after a failure overwrites its own partition: exactly once.

    Term counters need no state: a posting's position is derived from the table when it is read.
    """
    return _start(stream, index.add, checkpoint, available_now)


def ingest_descriptors(
    stream: DataFrame, index: ImageIndex, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append images; an image's descriptors must come in one batch."""
    return _start(stream, index.add, checkpoint, available_now)


def train_codebook(stream: DataFrame, trainer: SequentialKMeans, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Train a codebook with descriptors as they come: the first micro-batch gives the first centres, each later one trains them.

    A micro-batch that is replayed begins with the same version of the centres and writes its own again.
    """
    return _start(stream, trainer.update, checkpoint, available_now)
