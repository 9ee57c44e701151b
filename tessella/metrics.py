"""Timings of named phases and means over queries."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from statistics import mean

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Metrics:
    """Seconds by phase, and row counts observed while a query runs."""

    def __init__(self) -> None:
        self.seconds: dict[str, list[float]] = defaultdict(list)
        self.rows: dict[str, Observation] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name].append(time.perf_counter() - began)

    def counted(self, name: str, df: DataFrame) -> DataFrame:
        """The same rows; their number is known after the next action, without another job."""
        self.rows[name] = Observation(name)
        return df.observe(self.rows[name], F.count(F.lit(1)).alias("rows"))

    def report(self, spark: SparkSession) -> DataFrame:
        """``(phase, runs, mean_s)``."""
        rows = [(n, len(s), float(mean(s))) for n, s in sorted(self.seconds.items())]
        return spark.createDataFrame(rows, "phase string, runs int, mean_s double")
