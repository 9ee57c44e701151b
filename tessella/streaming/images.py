"""Histograms of images whose descriptors arrive in several micro-batches: state for each image until it is whole."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import vision
from .counters import PROVIDER, ROCKS

SCHEMA = "image_id long, centre int, tf long"


class Gather(StatefulProcessor):
    """Counts an image's visual words until ``expected`` descriptors have come, then gives the histogram out, once.

    With ``idle_ms`` an image that has had no descriptor for so long is given out as it is. What comes for an image that was
    given out is left out.
    """

    def __init__(self, idle_ms: int = 0):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState("seen", "n long, done boolean")
        self._tf = handle.getMapState("tf", "centre int", "tf long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, done = self._seen.get() or (0, False)
        if done:
            return
        own: Counter[int] = Counter()
        expected = 0
        for r in rows:
            own[r.centre] += 1
            expected = max(expected, r.expected or 0)
        n += sum(own.values())
        for centre, tf in own.items():
            before = self._tf.getValue((centre,))
            self._tf.updateValue((centre,), ((before[0] if before else 0) + tf,))
        if 0 < expected <= n:
            yield from self._out(key[0], n)
        else:
            self._seen.update((n, False))
            if self.idle_ms:
                for old in list(self._handle.listTimers()):
                    self._handle.deleteTimer(old)
                self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        n, done = self._seen.get() or (0, False)
        if not done:
            yield from self._out(key[0], n)

    def _out(self, image: int, n: int) -> Iterator[Row]:
        for (centre,), (tf,) in list(self._tf.iterator()):
            yield Row(image_id=image, centre=centre, tf=tf)
        self._tf.clear()
        self._seen.update((n, True))

    def close(self) -> None:
        pass


def histograms(stream: DataFrame, codebook: DataFrame, technique: str = "kmeans", idle_ms: int = 0) -> DataFrame:
    """``(image_id, centre, tf)`` of each image of a stream ``(image_id, desc_no, vec, expected)``, when its descriptors are all there.

    ``expected`` is an image's number of descriptors, the greatest of its rows'. The codebook must fit a task: a stream has one
    pass. Null vectors and ones of another length are never counted; rows without an image are left out.
    """
    if len(vision._Blocks(codebook).numbers) > 1:
        raise ValueError("the codebook is too large for a stream")
    found = vision.placed(stream.where("image_id IS NOT NULL").select("image_id", "desc_no", "vec", "expected"), codebook, technique)
    mode = "ProcessingTime" if idle_ms else "None"
    return found.select("image_id", "centre", "expected").groupBy("image_id").transformWithState(Gather(idle_ms), SCHEMA, "Append", mode)


def ingest_histograms(stream: DataFrame, codebook: DataFrame, path: str, checkpoint: str, technique: str = "kmeans", idle_ms: int = 0, available_now: bool = False) -> StreamingQuery:
    """Write the histograms of whole images as they become known, a folder for each micro-batch; a replayed one overwrites its own."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        made = histograms(stream, codebook, technique, idle_ms)
        writer = made.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/batch={n}"))
        writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)
