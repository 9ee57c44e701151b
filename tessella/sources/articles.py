"""Files of many articles as a Spark data source, in batch and as a stream.

    spark.dataSource.register(ArticleSource)
    spark.read.format("articles").option("splitBytes", 1 << 26).load(folder)

An article is what stands between a line that starts with ``<doc `` and the next that starts with ``</doc``. A file is cut into
byte ranges; a range has the articles that open in it, and its task reads on to the end of the last one. So a file larger than a
task is read by several, and no article twice. ``start`` is the byte where an article opens: with the path it tells all articles
apart and gives their order. Files are read in blocks of lines; memory holds one article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.text_index import dense_ids

OPEN, CLOSE = b"<doc ", b"</doc"
TITLE = re.compile(r'title="([^"]*)"')
SCHEMA = "path string, start long, title string, text string"
SPLIT_BYTES = 64 << 20


def _filesystem(path: str):
    """File system and path in it; paths without a scheme are local or shared folders."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_articles(path: str, suffix: str = ".txt") -> list[tuple[str, int]]:
    """``(path, bytes)`` of a folder's files, or of one file, by path; hidden files are left out."""
    from pyarrow import fs

    files, where = _filesystem(path)
    info = files.get_file_info(where)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(where))
    scheme = path[: len(path) - len(where)] if path.endswith(where) else ""
    named = [(i.path, i.size) for i in found if i.type == fs.FileType.File and i.base_name.endswith(suffix) and i.base_name[0] not in "._"]
    return sorted((scheme + p, n) for p, n in named)


@dataclass
class Range(InputPartition):
    """The articles of a file that open at ``start`` or later and before ``end``."""

    path: str
    start: int
    end: int
    limit: int = 0

    def __post_init__(self) -> None:
        super().__init__((self.path, self.start, self.end))


def _lines(path: str, start: int) -> Iterator[tuple[int, bytes]]:
    """Lines that begin at byte ``start`` or later, with where they begin."""
    files, where = _filesystem(path)
    with files.open_input_file(where) as f:
        at = max(start - 1, 0)
        f.seek(at)
        rest, skip = b"", start > 0
        while block := f.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                if skip:
                    skip = False
                else:
                    yield at, line
                at += len(line) + 1
        if rest and not skip:
            yield at, rest


def articles_of(part: Range, bodies: bool = True) -> Iterator[tuple[str, int, str | None, str | None]]:
    """Rows of a range. An article that is never closed is left out; lines outside articles belong to none."""
    opened, title, body, n = None, None, [], 0
    for at, line in _lines(part.path, part.start):
        line = line.removesuffix(b"\r")
        if line.startswith(OPEN):
            if at >= part.end:
                return
            found = TITLE.search(line.decode("utf-8", "replace"))
            opened, title, body = at, found and found[1], []
        elif line.startswith(CLOSE) and opened is not None:
            text = b"".join(x + b"\n" for x in body).decode("utf-8", "replace") if bodies else None
            yield part.path, opened, title, text
            n += 1
            opened = None
            if n == part.limit:
                return
        elif opened is None:
            if at >= part.end:
                return
        elif bodies:
            body.append(line)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.limit = int(options.get("limit", 0))
        self.bodies = options.get("bodies", "true").lower() != "false"

    def partitions(self) -> list[Range]:
        return [Range(p, at, min(at + self.split, size), self.limit) for p, size in list_articles(self.path) for at in range(0, size, self.split)]

    def read(self, partition: Range):
        return articles_of(partition, self.bodies)


class _StreamReader(DataSourceStreamReader):
    """An offset is the path of the last file that was read: files must arrive under names that sort after earlier ones."""

    def __init__(self, options: dict):
        self.reader = _Reader(options)

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        found = list_articles(self.reader.path)
        return {"after": found[-1][0] if found else ""}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for r in self.reader.partitions() if start["after"] < r.path <= end["after"]]

    def read(self, partition: Range):
        return articles_of(partition, self.reader.bodies)


class ArticleSource(DataSource):
    """Options: ``path``; ``splitBytes``, the bytes of a task; ``limit``, articles a task reads at most; ``bodies`` = false leaves ``text`` null."""

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read_article_files(spark: SparkSession, path: str, limit: int = 0, bodies: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(doc_id, path, article_no, title, text)``: articles numbered by path and place over all files, and within their file.

    ``limit`` keeps the first articles by that order; no task reads more than so many. ``bodies`` = False reads titles only.
    """
    spark.dataSource.register(ArticleSource)
    rows = spark.read.format("articles").option("splitBytes", split_bytes).option("limit", limit).option("bodies", bodies).load(path)
    numbered = dense_ids(rows, F.asc("path"), F.asc("start"))
    if limit > 0:
        numbered = numbered.where(F.col("doc_id") < limit)
    first = numbered.groupBy("path").agg(F.min("doc_id").alias("first"))
    return numbered.join(first, "path").select("doc_id", "path", (F.col("doc_id") - F.col("first")).alias("article_no"), "title", "text")


def stream_article_files(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, start, title, text)`` of articles as their files arrive."""
    spark.dataSource.register(ArticleSource)
    return spark.readStream.format("articles").option("splitBytes", split_bytes).load(path)


def write_article_files(rows: DataFrame, path: str, files: int) -> None:
    """Articles ``(title, text)`` as ``files`` text files of several articles each, under names that sort in any later write's order."""
    line = F.concat(F.lit('<doc title="'), F.coalesce("title", F.lit("")), F.lit('">\n'), F.coalesce("text", F.lit("")), F.lit("\n</doc>"))
    rows.select(line.alias("value")).repartition(files).write.mode("append").text(path)
