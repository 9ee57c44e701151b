"""Boolean retrieval with TF-IDF ranking, for one query or a batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import boolean as B
from .text_index import collection_size, document_frequencies

TOP_K = 10
#: Scores are rounded so that the order of a floating-point sum cannot change a ranking.
DIGITS = 6


def idf(n: Column, df: Column) -> Column:
    """log10(N / df), 0 for an unknown term."""
    return F.when(df > 0, F.log10(n / df)).otherwise(F.lit(0.0))


def named_terms(query: str | B.Node, norm: Callable[[str], str] = str.lower) -> list[str]:
    """The terms that a query names: all that a search needs of the counts."""
    return sorted(B.words(B.parse(query, norm) if isinstance(query, str) else query))


def _weights(counts: DataFrame, docs: DataFrame, terms: Sequence[str], stats: DataFrame | None, size: int | None) -> DataFrame:
    """idf of the named terms: as many rows as the query has terms, so a broadcast is bounded by the query."""
    known = stats if stats is not None else document_frequencies(counts.where(F.col("term").isin(*terms)))
    known = known.where(F.col("term").isin(*terms))
    return known.select("term", idf(collection_size(docs) if size is None else F.lit(size), F.col("df")).alias("idf"))


def matches(
    counts: DataFrame,
    docs: DataFrame,
    query: str | B.Node,
    norm: Callable[[str], str] = str.lower,
    stats: DataFrame | None = None,
    size: int | None = None,
) -> DataFrame:
    """All matching documents ``(doc_id, score)``, unordered.

    Postings of the named terms are read once and aggregated by document into a flag for each term and the score;
    the query is then one predicate. All documents are joined only if the query can hold without any term.
    ``stats`` are stored document frequencies and ``size`` the number of documents; without them they are counted.
    """
    tree = B.parse(query, norm) if isinstance(query, str) else query
    times = B.words(tree)
    terms = sorted(times)
    flag = {t: f"has_{i}" for i, t in enumerate(terms)}
    weights = F.broadcast(_weights(counts, docs, terms, stats, size))
    repeated = F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(times[t]))])
    hits = (
        counts.where(F.col("term").isin(*terms))
        .join(weights, "term")
        .groupBy("doc_id")
        .agg(
            *[F.max(F.col("term") == F.lit(t)).alias(flag[t]) for t in terms],
            F.sum(F.col("tf") * F.col("idf") * repeated[F.col("term")]).alias("score"),
        )
    )
    if B.needs_universe(tree):
        hits = docs.select("doc_id").join(hits, "doc_id", "left").fillna(False).fillna(0.0, ["score"])
    return hits.where(B.predicate(tree, lambda t: F.col(flag[t]))).select(
        "doc_id", F.round("score", DIGITS).alias("score")
    )


def search(counts: DataFrame, docs: DataFrame, query: str | B.Node, k: int | None = TOP_K, **how) -> DataFrame:
    """The ``k`` best ``(doc_id, score)``, ties by doc_id; all of them, unordered, if ``k`` is None."""
    found = matches(counts, docs, query, **how)
    return found if k is None else found.orderBy(F.desc("score"), "doc_id").limit(k)


def search_batch(
    counts: DataFrame,
    docs: DataFrame,
    queries: Sequence[tuple[int, str]],
    k: int = TOP_K,
    norm: Callable[[str], str] = str.lower,
    stats: DataFrame | None = None,
    size: int | None = None,
) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` of many queries in one job.

    Postings of all named terms are read once; each goes to the queries that name its term. The rank filter is
    applied within tasks before the shuffle by query, so a query with many hits does not fill a task.
    """
    trees = {i: B.parse(q, norm) for i, q in queries}
    spark = counts.sparkSession
    uses = [(i, t, n) for i, tree in trees.items() for t, n in B.words(tree).items()]
    terms = sorted({t for _, t, _ in uses})
    named = F.broadcast(spark.createDataFrame(uses, "query_id int, term string, times int"))
    weights = F.broadcast(_weights(counts, docs, terms, stats, size))
    hits = (
        counts.where(F.col("term").isin(*terms))
        .join(weights, "term")
        .join(named, "term")
        .groupBy("query_id", "doc_id")
        .agg(F.collect_set("term").alias("terms"), F.sum(F.col("tf") * F.col("idf") * F.col("times")).alias("score"))
    )
    if wide := [i for i, tree in trees.items() if B.needs_universe(tree)]:
        universe = docs.select(F.explode(F.array(*[F.lit(i) for i in wide])).alias("query_id"), "doc_id")
        seen = hits.where(F.col("query_id").isin(wide))
        none = F.array().cast("array<string>")
        everywhere = universe.join(seen, ["query_id", "doc_id"], "left").select(
            "query_id",
            "doc_id",
            F.coalesce("terms", none).alias("terms"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
        hits = hits.where(~F.col("query_id").isin(wide)).unionByName(everywhere)
    rule = F.lit(False)
    for i, tree in trees.items():
        rule = F.when(
            F.col("query_id") == i, B.predicate(tree, lambda t: F.array_contains("terms", t))
        ).otherwise(rule)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (
        hits.where(rule)
        .select("query_id", "doc_id", F.round("score", DIGITS).alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "doc_id", "score")
    )
