"""A stored index over many adds: a bounded number of files, the same answers before, during and after merges."""

import pytest
from pyspark.sql import functions as F

from tessella import engine
from tessella.engine import TextIndex, _bucket_of
from tessella.functions import text as X
from tessella.operators import text_search
from tessella.segments import Conflict, Manifest

QUERIES = ("thing", "thing || !tion", "(hand && tion) || ther")


def answers(index):
    return [[tuple(r) for r in index.search(q).collect()] for q in QUERIES]


def wanted(docs):
    counts = X.term_counts(docs, ["the"])
    return [[tuple(r) for r in text_search.search(counts, docs, q, norm=X.query_word).collect()] for q in QUERIES]


def test_many_small_adds(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("doc_id < 50")
    rows = docs.collect()
    index = TextIndex(spark, str(tmp_path / "t"), ["the"], fan=4).create()
    for k in range(25):
        index.add(spark.createDataFrame(rows[2 * k : 2 * k + 2], docs.schema), k)
    live = index.manifest.read()[1]
    # Fewer than fan segments of each of three tiers.
    assert len(live) <= 9 and {s["tier"] for s in live} == {0, 1, 2}
    want = wanted(docs)
    assert answers(index) == want
    before = [index.search(q) for q in QUERIES]
    old = {s["name"] for s in live}
    index.compact(all_=True)
    # Searches that began before the merge read what they began with.
    assert [[tuple(r) for r in b.collect()] for b in before] == want
    assert answers(index) == want and len(index.manifest.read()[1]) == 1
    assert index.vacuum() == [] and old <= set(index.vacuum(0))
    assert answers(index) == want
    assert index.manifest.files() <= 2 * 4**3 + 2
    stats = {(r.term, r.df, r.max_tf) for r in index.statistics().collect()}
    counts = X.term_counts(docs, ["the"]).collect()
    by = {}
    for r in counts:
        by.setdefault(r.term, []).append(r.tf)
    assert stats == {(t, len(tf), max(tf)) for t, tf in by.items()}


def test_search_reads_stored_statistics_and_folders(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    index = TextIndex(spark, str(tmp_path / "t"), [], fan=2).create()
    index.add(docs.where("doc_id < 90"), 1)
    index.add(docs.where("doc_id >= 90"), 2)
    found = index.search("thing && tion")
    paths = set(found.inputFiles())
    assert paths and all("/docs/" not in p for p in paths)
    (s,) = index.manifest.read()[1]
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in paths} <= {_bucket_of(t, s["buckets"]) for t in ("thing", "tion")}
    assert s["docs"] == docs.count()


def test_repeated_and_merged_batches(spark, tmp_path):
    one, two, three = (spark.createDataFrame([(i, t)], "doc_id long, text string") for i, t in ((1, "alpha"), (2, "beta"), (None, "gamma")))
    index = TextIndex(spark, str(tmp_path / "t"), [], fan=3).create()
    index.add(one, 1)
    index.add(two, 1)
    assert [r.doc_id for r in index.docs.collect()] == [2]
    index.add(one, 2)
    index.add(three, 3)
    assert len(index.manifest.read()[1]) == 1 and index.docs.count() == 2
    index.add(one, 2)
    assert index.docs.count() == 2 and index.size() == 2
    assert index.clear().search("alpha").collect() == [] and index.size() == 0 and index.docs.count() == 0


def test_writers_that_meet(spark, tmp_path):
    log = Manifest(spark, str(tmp_path / "m"))
    log.change(lambda live: [{"name": "a"}])
    version, live = log.read()
    other = Manifest(spark, str(tmp_path / "m"))
    other.commit(version, [*live, {"name": "b"}])
    with pytest.raises(Conflict):
        log.commit(version, [*live, {"name": "c"}])
    assert log.change(lambda now: [*now, {"name": "c"}])
    assert [s["name"] for s in other.read()[1]] == ["a", "b", "c"]
    assert not log.change(lambda now: None)
    assert all(not n.startswith(".draft") for n, _ in log.names("manifest"))


def test_a_large_folder_is_sorted_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine, "TASK_BYTES", 1 << 14)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    rows = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("doc_id"), F.lit("hot").alias("term"), F.lit(1).alias("tf"))
    index = TextIndex(spark, str(tmp_path / "i"), ())
    assert index._write("s", "postings", rows, 1) == [0]
    found = list((tmp_path / "i" / "segments" / "s" / "postings" / "bucket=0").glob("*.parquet"))
    assert len(found) > 1 and spark.read.parquet(*map(str, found)).distinct().count() == 40_000
    assert spark.conf.get(size) == before
