"""Positions of postings and the labels made of them."""

import hashlib
import hmac
import random
import struct

from pyspark.sql import functions as F

from tessella.functions import keyed
from tessella.operators import sealed_index, text_index

SCHEMA = "doc_id long, term string, tf int"


def brute(rows):
    by = {}
    for i, t, tf in rows:
        if i is not None and t is not None:
            by.setdefault(t, []).append((i, tf))
    return sorted((t, k, i, tf) for t, own in by.items() for k, (i, tf) in enumerate(sorted(own)))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("term", "pos", "doc_id", "tf").collect())


def test_positions_of_hot_terms_and_sparse_ids(spark):
    r = random.Random(1)
    rows = [(i * 2**40 + r.randrange(2**30), "hot", 1) for i in range(-50, 400)]
    rows += [(r.randrange(2**62), f"t{r.randrange(40)}", r.randrange(1, 5)) for _ in range(300)]
    rows += [(5, "z", 1), (None, "hot", 3), (None, None, 1), (7, None, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    for size in (10, 64, 1 << 20):
        assert rows_of(text_index.postings(df, size)) == brute(rows)
    one = spark.createDataFrame([(i, "x", 1) for i in range(97)], SCHEMA)
    assert rows_of(text_index.postings(one, 10)) == brute([(i, "x", 1) for i in range(97)])
    assert text_index.postings(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_ids_keep_a_place_each(spark):
    rows = [(4, "a", 1), (4, "a", 1), (4, "a", 2), (1, "a", 1)]
    assert rows_of(text_index.postings(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_labels_equal_the_library_of_python(spark):
    r = random.Random(2)
    rows = [(bytearray(r.randbytes(32)), n) for n in (0, 1, 255, 256, 2**31 - 1)] + [(None, 1), (bytearray(32), None)]
    df = spark.createDataFrame(rows, "k binary, n long").select("k", "n", keyed.label(F.col("k"), F.col("n")).alias("l"))
    for k, n, got in df.collect():
        want = None if k is None or n is None else hmac.digest(bytes(k), struct.pack("<i", n), hashlib.sha256)
        assert (None if got is None else bytes(got)) == want
    (c,) = spark.range(3, 4).select(keyed.centre_key(b"m" * 64, F.col("id"))).first()
    assert bytes(c) == hmac.digest(b"m" * 64, struct.pack("<I", 3), hashlib.sha256)


def test_sealed_store_is_opened_by_counters_alone(spark):
    rows = [(i, f"t{i % 3}", i + 1) for i in range(20)]
    placed = text_index.postings(spark.createDataFrame(rows, SCHEMA))
    store = sealed_index.sealed(placed, b"m" * 32, b"k" * 16).cache()
    assert store.select("label").distinct().count() == 20 and store.columns == ["label", "inside", "record"]
    asked = spark.createDataFrame([("t1", 7), ("none", 0), ("more", 2)], "term string, df long")
    got = sealed_index.opened(store, sealed_index.wanted(asked, b"m" * 32), b"k" * 16)
    assert sorted((r.id, r.tf) for r in got.collect()) == [(i, i + 1) for i in range(1, 20, 3)]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    swapped = store.select(F.col("label"), F.lit(bytearray(32)).alias("inside"), "record")
    try:
        sealed_index.opened(swapped, sealed_index.wanted(asked, b"m" * 32), b"k" * 16).collect()
        raise AssertionError("a record under another label was opened")
    except Exception as e:
        assert "label does not match" in str(e)


def test_a_lookup_shuffles_only_what_it_may_want(spark, monkeypatch):
    rows = [(i, f"t{i % 300}", i + 1) for i in range(3000)]
    placed = text_index.postings(spark.createDataFrame(rows, SCHEMA))
    store = sealed_index.sealed(placed, b"m" * 32, b"k" * 16).cache()
    asked = sealed_index.wanted(spark.createDataFrame([("t1", 10), ("t7", 10), ("none", 2)], "term string, df long"), b"m" * 32)
    assert 20 <= sealed_index.thinned(store, asked).count() < 40
    got = sorted((r.term, r.id, r.tf) for r in sealed_index.opened(store, asked, b"k" * 16).collect())
    assert got == sorted((t, i, n) for i, t, n in rows if t in ("t1", "t7"))
    monkeypatch.setattr(sealed_index, "BITS", 1 << 8)
    assert len(got) == sealed_index.opened(store, asked, b"k" * 16).count() < sealed_index.thinned(store, asked).count()


def test_labels_are_made_where_postings_are(spark):
    rows = [(t, n, 1, 1) for t in ("a", "é", None) for n in (0, 255, 2**31 - 1, None)]
    placed = spark.createDataFrame(rows, "term string, pos long, doc_id long, tf int")
    got = sealed_index.labelled(placed, b"m" * 32)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        key = None if r.term is None else hmac.digest(b"m" * 32, r.term.encode(), hashlib.sha256)
        want = None if key is None or r.pos is None else hmac.digest(key, struct.pack("<i", r.pos), hashlib.sha256)
        assert (None if r.label is None else bytes(r.label)) == want


def test_places_are_those_of_the_postings(spark, monkeypatch):
    monkeypatch.setattr(text_index, "RUN", 7)
    rows = [(i, "hot", 1) for i in range(40)] + [(i, f"t{i % 3}", 1) for i in range(7)] + [(4, "a", 1), (4, "a", 1), (None, "a", 1), (2, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for size in (10, 1 << 20):
        assert sorted(tuple(r) for r in text_index.places(df, size).collect()) == [x[:2] for x in brute(rows)]
    assert text_index.places(spark.createDataFrame([], SCHEMA)).collect() == []


def test_labels_of_postings_shuffle_no_documents(spark, data):
    from tessella import queries

    plan = queries._labels(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" not in plan and "counts-" not in plan
