import hashlib
import random

import pytest

from tessella.llm import fuzzyhash as X


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(70))) for _ in range(2))
        assert X.edit_distance(a, b) == levenshtein(a, b)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + n[:k]
        own, changed, other = (X.fingerprints([x.encode()])[0] for x in (t, edited, n))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, X.likeness(own, changed), X.likeness(own, other)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in X.compared(df).collect()), key=str)


@pytest.mark.parametrize("bucket", [4000, 7])
def test_equals_brute_force_on_documents(spark, data, monkeypatch, bucket):
    monkeypatch.setattr(X, "BUCKET", bucket)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = got(docs)
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()])
    near = sorted(r[5] for r in found if r[1] > 100)
    assert near[len(near) // 20] > 0.4
    assert sum(r[6] > 0.3 for r in found) < 0.1 * len(found)


@pytest.mark.parametrize("bucket", [4000, 2])
def test_odd_rows(odd, monkeypatch, bucket):
    monkeypatch.setattr(X, "BUCKET", bucket)
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_one_and_no_document(make):
    assert got(make([(1, "abcd")])) == brute([(1, "abcd")])
    assert got(make([])) == []


def test_likeness():
    text = " ".join(f"word{i % 89}x{i % 53}" for i in range(400)).encode()
    a, b, c = X.fingerprints([text, text[:1500] + b" inserted " + text[1500:], b"\x01" * 3000])
    assert X.likeness(a, a) == 1.0 and 0.7 < X.likeness(a, b) < 1.0 and X.likeness(a, c) == 0.0
    assert X.likeness("0::", "0::") == 1.0 and X.likeness("0::", a) == 0.0
    assert X.likeness("8:ABCDEF:GHIJKL", "16:GHIJKL:XYZ") == 1.0
    assert X.fingerprints([text, b"", text])[0::2] == [a, a]


def test_pieces_cover_repetitive_texts():
    rng = random.Random(5)
    cut = lambda t: X.fingerprints([t.encode()])[0].split(":")
    lines = [t for _ in range(400) if len(cut(t := ("".join(rng.choice("klmnopqrs ") for _ in range(12)) + "\n") * 700)[1]) > X.SPAN]
    a, b, c = [t for t in lines if cut(t)[0] == cut(lines[0])[0]][:3]
    own, end, start = X.fingerprints([(a[:6700] + b[:2300]).encode(), (a[:6700] + c[:2300]).encode(), (c[:2300] + a[2300:6700] + b[:2300]).encode()])
    assert X.likeness(own, end) < 0.95 and 0.5 < X.likeness(own, start) < 1


def test_ids_of_other_types_in_many_buckets(make, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i} " * (i % 9)) for i in range(300)]
    named = make(rows).withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    plain = sorted(tuple(r)[1:] for r in X.compared(make(rows)).collect())
    for size in (4000, 20):
        monkeypatch.setattr(X, "BUCKET", size)
        assert sorted(tuple(r)[1:] for r in X.compared(named).collect()) == plain
        assert sorted(tuple(r)[1:] for r in X.compared(make(rows)).collect()) == plain
    assert X.with_next(make(rows).select("doc_id", "text")).select("bucket").distinct().count() > 8
