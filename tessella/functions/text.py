"""Text analysis: tokens, stop words, stems and per-document term counts."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import porter

#: Maximal runs of ASCII letters and digits; every other character, accented letters too, separates.
TOKEN = "[A-Za-z0-9]+"

# Fixed value: a word that the configured queries name although the index leaves it out.
QUERIED_STOP_WORDS = ("way",)

#: Words that a task counts at once, about; a row is counted whole.
PART_WORDS = 1 << 17
#: Bytes of words that a Python worker gets at once, so long texts do not add up.
BATCH_BYTES = 8 << 20

TERM_COUNTS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))


def default_stop_words(spark: SparkSession) -> list[str]:
    """Spark's public English list cut into tokens, every single letter, and QUERIED_STOP_WORDS.

    The list is a parameter wherever documents are analysed; pass ``read_stop_words`` of a file for another one.
    """
    from pyspark.ml.feature import StopWordsRemover

    words = {t for w in StopWordsRemover.loadDefaultStopWords("english") for t in re.findall(TOKEN, w.lower())}
    return sorted(words | set(string.ascii_lowercase) | set(QUERIED_STOP_WORDS))


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """Stop words of a text file, one a line; a list of words is bounded by a language's vocabulary."""
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> ''").distinct().collect()
    return sorted(r.w for r in rows)


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens in order. Extraction comes first: lower-casing first would make some letters ASCII."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, F.lower)


def without_stop_words(words: Column, stop_words: Iterable[str]) -> Column:
    """Tokens that are not stop words; tested before stemming."""
    stop = sorted(set(stop_words))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    """Porter stem of lower-case words; null stays null. Workers remember the words they have seen."""
    return words.map(porter.stem, na_action="ignore")


def _counted(words: pa.Array, stemmed: bool) -> pa.Array:
    """Terms of some rows' words. Each different word is stemmed once; rows are counted as numbers."""
    rows = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    seen = words.flatten().dictionary_encode()
    term_of, terms = seen.indices.to_numpy(zero_copy_only=False), seen.dictionary
    if stemmed:
        stems = pa.array([porter.stem(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
        term_of, terms = stems.indices.to_numpy(zero_copy_only=False)[term_of], stems.dictionary
    n = max(len(terms), 1)
    cells, times = np.unique(rows * n + term_of, return_counts=True)
    counts = pa.StructArray.from_arrays([terms.take(pa.array(cells % n)), pa.array(times, pa.int32())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(cells // n, np.arange(len(words) + 1)), pa.int32()), counts)


def _in_parts(words: pa.Array, stemmed: bool) -> pa.Array:
    """Rows of about PART_WORDS words at a time, so that what is held beside a batch does not grow with it."""
    so_far = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(), dtype="int64")
    cuts = np.unique(np.searchsorted(so_far, np.arange(PART_WORDS, so_far[-1] if len(so_far) else 0, PART_WORDS), "right"))
    bounds = [0, *(int(c) for c in cuts if 0 < c < len(words)), len(words)]
    return pa.concat_arrays([_counted(words.slice(i, j - i), stemmed) for i, j in zip(bounds, bounds[1:])])


@F.arrow_udf(TERM_COUNTS)
def _stemmed_counts(words: pa.Array) -> pa.Array:
    return _in_parts(words, True)


@F.arrow_udf(TERM_COUNTS)
def _plain_counts(words: pa.Array) -> pa.Array:
    return _in_parts(words, False)


def query_word(word: str) -> str:
    """What a query's word is looked up as: lower case and stemmed, no stop-word check."""
    return porter.stem("".join(c.lower() if c.isascii() else c for c in word))


def only_named(words: Column, terms: Iterable[str], stemmed: bool = True) -> Column:
    """Tokens that may give one of ``terms``, before rows are made of them; without stems, exactly those that do.

    The stemmer cuts a word's end and puts at most two letters of its own in place, so a word begins with all but the last
    two letters of its stem.
    """
    named = sorted(set(terms))
    if not named:
        return F.array().cast("array<string>")
    if not stemmed:
        return F.filter(words, lambda w: w.isin(named))
    heads = sorted({t[:-2] for t in named})
    return F.filter(words, lambda w: reduce(lambda a, b: a | b, (w.startswith(h) for h in heads)))


def term_counts(
    docs: DataFrame,
    stop_words: Iterable[str] = (),
    stemmed: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
    terms: Iterable[str] | None = None,
) -> DataFrame:
    """One row ``(doc_id, term, tf)`` for each document and term.

    A document is one row, so its terms are counted inside the row and nothing is shuffled. Without stems, rows with equal
    ids are one document: whether there are any is looked up first, and only then counts are added by a shuffle.
    Null and empty texts give no rows. Other columns are ignored. ``terms`` leaves only their rows, as a query that names them needs; other words are dropped inside the document's row.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    words = tokens(text)
    if terms is not None:
        terms = sorted(set(terms))
        words = only_named(words, terms, stemmed)
    if stop_words:
        words = without_stop_words(words, stop_words)
    if not stemmed and terms is None and not docs.isStreaming:
        counts = docs.select(F.col(doc_id).alias("doc_id"), F.inline(_plain_counts(words)))
        if docs.groupBy(doc_id).count().where("count > 1").isEmpty():
            return counts
        return counts.groupBy("doc_id", "term").agg(F.sum("tf").cast("int").alias("tf"))
    if not stemmed:
        return (
            docs.select(F.col(doc_id).alias("doc_id"), F.explode(words).alias("term"))
            .groupBy("doc_id", "term")
            .agg(F.count(F.lit(1)).cast("int").alias("tf"))
        )
    counts = docs.select(F.col(doc_id).alias("doc_id"), F.inline(_stemmed_counts(words)))
    return counts if terms is None else counts.where(F.col("term").isin(terms))


def document_terms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, term)`` of each row's different tokens, made inside the row: nothing is shuffled. Ids must differ."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(tokens(text))).alias("term"))
