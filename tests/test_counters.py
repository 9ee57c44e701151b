"""Counters of a stream: several batches, a restart, a batch that is replayed, ids in many blocks."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import text_index
from tessella.streaming import counters


def rows_of(df):
    return sorted((r.term, r.pos, r.doc_id, r.tf) for r in df.select("term", "pos", "doc_id", "tf").collect())


@pytest.fixture
def stream(spark, tmp_path):
    """A function that adds documents as a file, or runs a stream of all files to its end."""

    def run(batch=None):
        where = str(tmp_path / "in")
        if batch is not None:
            batch.coalesce(1).write.mode("append").parquet(where)
            return None
        docs = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(where)
        counters.ingest_positions(docs, str(tmp_path / "out"), str(tmp_path / "log"), available_now=True).awaitTermination()
        return counters.read_positions(spark, str(tmp_path / "out"))

    return run


def docs_of(spark, ids):
    return spark.createDataFrame([(i, f"tick tock word{i % 3}" + " tick" * (i % 2)) for i in ids], "doc_id long, text string")


def test_positions_go_on_over_batches_and_restarts(spark, stream, monkeypatch):
    monkeypatch.setattr(counters, "BLOCK", 4)
    stream(docs_of(spark, range(7)))
    first = stream()
    assert first.where("term = 'tick'").count() == 7
    stream(docs_of(spark, range(7, 12)))
    stream(docs_of(spark, range(12, 20)))
    got = stream()
    want = text_index.postings(X.term_counts(docs_of(spark, range(20))))
    assert rows_of(got) == rows_of(want)
    # Places that were given out before the restart stay.
    assert set(rows_of(first)) <= set(rows_of(got))


def test_replayed_batch_counts_once(spark, stream, tmp_path):
    import shutil

    stream(docs_of(spark, range(5)))
    stream(docs_of(spark, range(5, 9)))
    want = rows_of(stream())
    # As if the query had failed between writing its second batch and noting that it was done.
    (tmp_path / "log" / "commits" / "1").unlink()
    (tmp_path / "log" / "commits" / ".1.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out" / "batch=1")
    assert rows_of(stream()) == want


def test_null_ids_and_texts(spark, stream):
    stream(spark.createDataFrame([(None, "tick"), (3, None), (4, ""), (5, "tick tick")], "doc_id long, text string"))
    assert rows_of(stream()) == [("tick", 0, 5, 2)]
    assert spark.conf.get(counters.PROVIDER, None) != counters.ROCKS


def test_later_id_of_an_earlier_block_comes_after_its_block(spark, stream, monkeypatch):
    monkeypatch.setattr(counters, "BLOCK", 10)
    stream(docs_of(spark, [1, 15]))
    stream(docs_of(spark, [0, 30]))
    got = stream().where(F.col("term") == "tock")
    assert [r.doc_id for r in got.orderBy("pos").collect()] == [1, 0, 15, 30]


def test_places_are_given_without_a_row_of_python(spark, stream, monkeypatch):
    monkeypatch.setattr(counters, "BLOCK", 3)
    counts = X.term_counts(docs_of(spark, range(8)), stemmed=False).cache()
    got = counters.placed(counts)
    assert "Window" in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.block, r.place, r.doc_id) for r in got.where("term = 'tick'").collect())
    assert rows == [(i // 3, i % 3, i) for i in range(8)]
