"""From raw documents to token files: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, mixing, nearcopies, tokenfile, toxicity
from tessella.llm.queries import TOKENIZER
from tessella.llm.store import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic. Null and empty texts stay, as do rows with equal or null ids; without labels of both kinds all stay."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id (null last). Texts without words are copies of each other."""
    return nearcopies.clean(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item. Null and empty texts stay; an empty benchmark drops nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that sources meet their targets, as ``mixing.mix`` says. A null source is a source; rows with equal or null ids are rows."""
    return mixing.apply(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows by id, null first; null texts are empty. Returns the digest, a row for each row."""
    return tokenfile.digest(docs, TOKENIZER)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores, fingerprints, edit distances and token ids are not for SQL; tests compare with plain Python.
ORACLE_SQL = None
