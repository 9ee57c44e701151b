"""Readers of corpora, queries, codebooks and descriptors; writers of indexes and result files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text_index import dense_ids


def list_files(
    spark: SparkSession, path: str, pattern: str, limit: int = 0, one_level_down: bool = False, descending: bool = False
) -> DataFrame:
    """``(path, length)`` of files by name pattern, sorted; hidden files are left out; the first ``limit`` if above 0."""
    where = f"{path}/*/{pattern}" if one_level_down else f"{path}/{pattern}"
    found = spark.read.format("binaryFile").load(where).select("path", "length")
    found = found.where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    ordered = found.orderBy(F.desc("path") if descending else F.asc("path"))
    return ordered.limit(limit) if limit > 0 else ordered


def read_texts(spark: SparkSession, path: str, limit: int = 0, descending: bool = False) -> DataFrame:
    """``(doc_id, path, text)``: one file is one document; ids follow the order of the paths."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt*")
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    files = files.where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    order = F.desc("path") if descending else F.asc("path")
    numbered = dense_ids(files, order)
    return (numbered.where(F.col("doc_id") < limit) if limit > 0 else numbered).select("doc_id", "path", "text")


def articles(text: Column, compat: bool = False) -> Column:
    """The articles of a multi-article file, in order, as an array of texts.

    A line starting with ``<doc `` opens an article and is left out, one starting with ``</doc`` closes it; what
    follows the last close is dropped. ``compat`` keeps that rest as one empty document and cuts the token
    that ends a line, as indexes made that way expect.
    """
    pieces = F.split(F.regexp_replace(text, "\r\n", "\n"), "(?m)^</doc[^\n]*\n?")
    closed = F.slice(pieces, 1, F.size(pieces) - 1)
    bodies = F.transform(closed, lambda a: F.regexp_replace(a, "(?m)^<doc [^\n]*\n?", ""))
    if compat:
        bodies = F.transform(bodies, lambda a: F.regexp_replace(a, "(?m)[A-Za-z0-9]+$", ""))
        bodies = F.concat(bodies, F.array(F.lit("")))
    return bodies


def read_articles(
    spark: SparkSession, path: str, compat: bool = False, limit: int = 0, whole_files: bool = False, descending: bool = False
) -> DataFrame:
    """``(doc_id, path, article_no, text)`` of multi-article files.

    ``limit`` is exact; with ``whole_files`` it is checked after each file, so the last file is read to its end.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt*")
    rows = files.select(
        F.col("_metadata.file_path").alias("path"),
        F.posexplode(articles(F.col("value"), compat)).alias("article_no", "text"),
    )
    first = F.desc("path") if descending else F.asc("path")
    numbered = dense_ids(rows, first, F.asc("article_no"))
    if limit > 0:
        start = F.col("doc_id") - F.col("article_no") if whole_files else F.col("doc_id")
        numbered = numbered.where(start < limit)
    return numbered.select("doc_id", "path", "article_no", "text")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """``(path, article_no, title)`` of the articles that have a title."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt*")
    found = F.regexp_extract_all("value", F.lit('(?m)^<doc [^\n]*title="([^"]*)"'), F.lit(1))
    return files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(found).alias("article_no", "title"))


def tags_to_query(text: Column) -> Column:
    """A boolean query from a tag file: one tag a line (CRLF or LF), spaces become underscores, joined by OR."""
    lines = F.filter(F.split(text, "\r?\n"), lambda t: t != "")
    return F.array_join(F.transform(lines, lambda t: F.replace(t, F.lit(" "), F.lit("_"))), " || ")


def read_tag_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(path, query)`` of a folder of tag files."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt*")
    return files.select(F.col("_metadata.file_path").alias("path"), tags_to_query(F.col("value")).alias("query"))


def queries_from_config(spark: SparkSession, queries: Sequence[str]) -> DataFrame:
    """``(query_id, query)`` in the order of a configuration list."""
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def image_id(path: Column) -> Column:
    """Decimal digits that start the base name of a file; 0 where there are none."""
    digits = F.regexp_extract(F.element_at(F.split(path, "/"), -1), "^([0-9]+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("long"), F.lit(0).cast("long"))


def read_images(spark: SparkSession, path: str, one_level_down: bool = False) -> DataFrame:
    """``(image_id, path, content)`` of jpg files; features are extracted by the caller's ``mapInPandas``."""
    where = f"{path}/*/*.jpg*" if one_level_down else f"{path}/*.jpg*"
    files = spark.read.format("binaryFile").load(where)
    return files.select(image_id(F.col("path")).alias("image_id"), "path", "content")


def read_descriptors(
    vectors: DataFrame, per_image: int = 10, vec_id: str = "vec_id", vec: str = "embedding"
) -> DataFrame:
    """``(image_id, desc_no, vec)`` from a table of numbered vectors, ``per_image`` consecutive ones an image."""
    return vectors.select(
        F.floor(F.col(vec_id) / per_image).alias("image_id"), (F.col(vec_id) % per_image).alias("desc_no"), F.col(vec).alias("vec")
    )


def holidays_queries(spark: SparkSession) -> DataFrame:
    """Query ids of a public evaluation set: 500, by hundreds."""
    return spark.range(100000, 149901, 100).withColumnRenamed("id", "image_id")


def wang_queries(spark: SparkSession) -> DataFrame:
    """Query ids of a public evaluation set: 20, by fifties."""
    return spark.range(1, 1001, 50).withColumnRenamed("id", "image_id")


def write_codebook(codebook: DataFrame, path: str) -> None:
    codebook.write.mode("overwrite").parquet(path)


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_raw_codebook(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """A raw little-endian float32 matrix of rows of ``dim`` numbers, one file, as a codebook."""
    import numpy as np

    content = spark.read.format("binaryFile").load(path).select("content").first().content
    rows = np.frombuffer(content, "<f4").reshape(-1, dim)
    data = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "centre int, centre_vec array<float>")


def run_lines(results: DataFrame) -> DataFrame:
    """Lines ``<q>.jpg 0 <id>.jpg 1 <id>.jpg ...`` of ranked lists ``(query_id, rank, image_id)``, rank from 1.

    A query's list is a top-k, so gathering it is bounded by k.
    """
    cells = F.array_sort(F.collect_list(F.struct("rank", "image_id")))
    pairs = F.transform(
        cells, lambda c: F.concat_ws(" ", (c["rank"] - 1).cast("string"), F.concat(c.image_id.cast("string"), F.lit(".jpg")))
    )
    line = F.concat_ws(" ", F.concat(F.col("query_id").cast("string"), F.lit(".jpg")), F.array_join("pairs", " "))
    return results.groupBy("query_id").agg(pairs.alias("pairs")).select("query_id", line.alias("line"))


def write_run(results: DataFrame, path: str) -> None:
    """A run file, queries ascending."""
    run_lines(results).orderBy("query_id").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_stats(stats: Mapping[str, DataFrame], path: str) -> None:
    for name, df in stats.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_stats(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def lookup(store: DataFrame, wanted: DataFrame, key: str = "label") -> DataFrame:
    """Values of a batch of keys; a key that the store lacks has no row. Spark picks the join by the sides' sizes."""
    return store.join(wanted.select(key).distinct(), key)


def upsert(store: DataFrame, more: DataFrame, key: str = "label", order: str | None = None) -> DataFrame:
    """The store after a batch write: last write wins by key, one row of each key of ``more``.

    Of several rows of one key the one greatest by ``order`` is the last, ties and no ``order`` by the other columns.
    """
    rest = [c for c in more.columns if c != key]
    first = [c for c in rest if c == order]
    last = more.groupBy(key).agg(F.max(F.struct(*first, *(c for c in rest if c != order))).alias("_last")) if rest else more.distinct()
    last = last.select(key, "_last.*") if rest else last
    return store.join(last.select(key), key, "left_anti").unionByName(last)
