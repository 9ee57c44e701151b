"""The manifest against trees that are built in memory, level by level."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tessella.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    out = []
    for name in FIELDS:
        v = text if name == "text" else row[name]
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return H(*out)


def tree(nodes):
    """Root, and the siblings (left, right) of each leaf, level by level."""
    paths, above = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        grouped, level = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k in range(len(run)):
                for i in above[at + k]:
                    paths[i].append((run[:k], run[k + 1 :]))
            level.append(H(*run))
            grouped.append(sum(above[at : at + 3], []))
        nodes, above = level, grouped
    return nodes[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    made = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(by[source], key=lambda x: x[:3])
        made.append((leaves, *tree([x[2] for x in leaves])))
    root, tops = tree([m[1] for m in made])
    out = []
    for (leaves, subroot, paths), top in zip(made, tops):
        for (_, _, leaf, r), path in zip(leaves, paths):
            path = path + top
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            at = leaf_of(r, text)
            for left, right in path:
                at = H(*left, at, *right)
            proof = H(*[d for left, right in path for d in (*left, *right)])
            out.append((r["doc_id"], leaf, subroot, root, proof, at, at == root))
    return sorted(out, key=repr)


def rows_of(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_digest_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = brute([r.asDict() for r in docs.collect()])
    assert rows_of(merkle.digest(docs)) == want
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("n, parts", [(1, 1), (4, 3), (28, 7), (2500, 3)])
def test_any_size_and_partitioning(spark, n, parts):
    """A hot group over all partitions, one of a single row and a null one; every cut gives the same trees."""
    df = spark.range(n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 11 == 3, None).when(F.col("id") == 0, "é").otherwise("hot").alias("source"),
        F.lit(None).cast("string").alias("lang"), F.lit(7).alias("n_chars"), F.concat(F.lit("a\n"), F.col("id").cast("string")).alias("text"),
    )
    want = brute([r.asDict() for r in df.collect()])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert rows_of(merkle.digest(df)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_low_strides_and_small_pieces(spark, monkeypatch):
    """Many rounds of ragged nodes give what one round gives."""
    monkeypatch.setattr(merkle, "STRIDE", 1)
    monkeypatch.setattr(merkle, "PIECE_ROWS", 20)
    df = spark.range(300).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', concat('b', id % 40)) AS source", "'x' AS lang", "1 AS n_chars", "'\\n' AS text")
    assert rows_of(merkle.digest(df)) == brute([r.asDict() for r in df.collect()])


def test_odd_rows(odd):
    rows = [{n: r[n] for n in FIELDS} for r in odd.collect()]
    assert rows_of(merkle.digest(odd)) == brute(rows)


def test_empty_table_and_names(spark, make):
    assert merkle.digest(make([])).collect() == []
    df = make([(1, "a"), (2, "b")]).selectExpr("*", "'z' AS piece", "'z' AS grp", "'z' AS digest", "'z' AS path", "'z' AS leaf")
    assert rows_of(merkle.digest(df)) == brute([{n: r[n] for n in FIELDS} for r in df.select(*FIELDS).collect()])


def test_proofs_of_a_changed_row_fail(spark):
    df = spark.range(50).selectExpr("id AS doc_id", "'s' AS source", "'x' AS lang", "1 AS n_chars", "concat('t', id) AS text")
    found = merkle.manifest(df, changed=F.when(F.col("doc_id") == 9, "other").otherwise(F.col("text")))
    held = found.select("doc_id", (merkle.fold(F.coalesce("changed_leaf", "leaf"), F.col("path")) == F.col("root")).alias("ok"))
    assert [r.doc_id for r in held.collect() if not r.ok] == [9]
