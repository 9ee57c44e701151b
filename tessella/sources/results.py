"""Rankings as binary result files: a data source that writes and reads the fixed layouts of search answers.

    spark.dataSource.register(ResultSource)
    ranking.write.format("rankings").option("layout", "text").mode("append").save(folder)

A task writes a file of its own under a folder that no reader looks into; the driver moves the files of all tasks into place
when all have succeeded, and deletes them when one has failed. A ranking of one partition is one file, in its order.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .articles import _filesystem

# Little-endian head (count, and for texts whether there are scores) and row (id, score) of each kind of answer.
LAYOUTS = {"text": ("<QB", "<id"), "image": ("<Q", "<Qd"), "fused": ("<I", "<Id")}
SCHEMA = "file string, place long, id long, score double"


def encode(rows: list[tuple[int, float]], layout: str) -> bytes:
    """A ranking's bytes. A null id or score, or an id that the layout has no room for, is an error."""
    head, row = LAYOUTS[layout]
    first = (len(rows), 1) if layout == "text" else (len(rows),)
    return struct.pack(head, *first) + b"".join(struct.pack(row, i, s) for i, s in rows)


def decode(data: bytes, layout: str) -> list[tuple[int, float]]:
    """The rows that the head counts; what may follow them is padding."""
    head, row = LAYOUTS[layout]
    n, at, size = struct.unpack_from(head, data)[0], struct.calcsize(head), struct.calcsize(row)
    if len(data) < at + n * size:
        raise ValueError(f"{n} rows need {at + n * size} bytes; there are {len(data)}")
    return [struct.unpack_from(row, data, at + k * size) for k in range(n)]


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.layout, self.overwrite = options["path"].rstrip("/"), options.get("layout", "text"), overwrite
        if self.layout not in LAYOUTS:
            raise ValueError(f"unknown layout {self.layout!r}")
        self.draft = f"{self.path}/_draft-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        rows: list[tuple[int, float]] = []
        for b in iterator:
            rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        if not rows:
            return _Written(None)
        files, where = _filesystem(self.draft)
        name = f"ranking-{uuid.uuid4().hex}.bin"
        files.create_dir(where, recursive=True)
        with files.open_output_stream(f"{where}/{name}") as out:
            out.write(encode(rows, self.layout))
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, where = _filesystem(self.path)
        files.create_dir(where, recursive=True)
        old = [p for p, _ in list_results(self.path)] if self.overwrite else []
        draft = _filesystem(self.draft)[1]
        for m in messages:
            if m is not None and m.name is not None:
                files.move(f"{draft}/{m.name}", f"{where}/{m.name}")
        for p in old:
            files.delete_file(_filesystem(p)[1])
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, draft = _filesystem(self.draft)
        if files.get_file_info(draft).type == fs.FileType.Directory:
            files.delete_dir(draft)


def list_results(path: str) -> list[tuple[str, int]]:
    from .articles import list_articles

    return list_articles(path, ".bin")


@dataclass
class _File(InputPartition):
    path: str

    def __post_init__(self) -> None:
        super().__init__(self.path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout = options["path"], options.get("layout", "text")

    def partitions(self) -> list[_File]:
        return [_File(p) for p, _ in list_results(self.path)]

    def read(self, partition: _File):
        files, where = _filesystem(partition.path)
        with files.open_input_file(where) as f:
            rows = decode(f.read(), self.layout)
        for place, (i, score) in enumerate(rows):
            yield partition.path, place, i, score


class ResultSource(DataSource):
    """Options: ``path``; ``layout``, one of LAYOUTS. Rows to write are an id and a score, in this order."""

    @classmethod
    def name(cls) -> str:
        return "rankings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def write_ranking(ranking: DataFrame, path: str, layout: str, mode: str = "append") -> None:
    """A ranking ``(id, score)``, its first two columns, a file for each of its partitions with rows."""
    ranking.sparkSession.dataSource.register(ResultSource)
    ranking.write.format("rankings").option("layout", layout).mode(mode).save(path)


def read_rankings(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """``(file, place, id, score)`` of all result files of a folder, places from 0."""
    spark.dataSource.register(ResultSource)
    return spark.read.format("rankings").option("layout", layout).load(path)
