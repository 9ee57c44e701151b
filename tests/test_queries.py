import pytest

from oracle import compare
from tessella import queries

REGISTRY = queries.registry()


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_query_equals_sql(spark, data, name):
    query, sql = REGISTRY[name]
    compare(spark, data, query, sql)


def test_kmeans_codebook_shape_and_gain(spark, data):
    from pyspark.sql import functions as F

    from tessella.operators import vision

    book = REGISTRY["kmeans_codebook"][0](spark, data)
    x = queries.descriptors(spark, data)
    assert book.count() == queries.K
    cost = lambda b: vision.compactness(vision.assign(x, b)).first()[0]
    assert cost(book) < cost(queries.codebook(spark, data))
    assert book.where(F.size("centre_vec") == 64).count() == queries.K


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_empty_docs_are_those_without_terms(spark, tmp_path):
    rows = [(1, "short"), (2, ""), (3, None), (4, " \n–!"), (5, "a text of over forty characters, with terms")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in REGISTRY["empty_docs"][0](spark, str(tmp_path)).collect()) == [2, 3, 4]
