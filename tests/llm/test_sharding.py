import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import sharding as X


def check(docs, limit, out):
    rows = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    for own in shards.values():
        assert own[0].shard_bytes == sum(r.n_bytes for r in own) and own[0].shard_docs == len(own)
        assert own[0].shard_bytes <= limit or len(own) == 1
        assert own[0].depth == len(own[0].shard)
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for a in names:
        if a:
            up = a[:-1]
            inside = [r for n in names if n.startswith(up) for r in shards[n]]
            assert sum(r.n_bytes for r in inside) > limit and len(inside) > 1
    return shards


@pytest.mark.parametrize("limit", [2_000, 20_000, 10**9])
def test_buckets_fit_and_only_full_ones_split(spark, data, limit):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    check(docs, limit, X.shards(docs, limit))


def test_one_key_and_equal_rows_are_parted(make):
    docs = make([(7, "same text of one key")] * 60 + [(7, f"other {i}") for i in range(20)] + [(i, "x" * 30) for i in range(30)])
    shards = check(docs, 100, X.shards(docs, 100))
    assert max(map(len, shards)) > 64


def test_odd_rows_and_empty_table(odd, make):
    check(odd, 50, X.shards(odd, 50))
    assert X.shards(make([])).count() == 0


def test_write(spark, make, tmp_path):
    docs = make([(i, "t" * 50) for i in range(40)])
    X.write(docs, str(tmp_path / "s"), 300)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 40
    sums = back.groupBy("shard").sum("n_chars").collect()
    assert max(r[1] for r in sums) <= 300


def test_write_keeps_columns_of_any_name(spark, make, tmp_path):
    docs = make([(i % 5, "t" * 50) for i in range(40)] + [(None, None)])
    for name in ("bits", "n_bytes", "shard", "_ROW", "prefix", "row"):
        docs = docs.withColumn(name, F.lit("kept"))
    X.write(docs, str(tmp_path / "s"), 300)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.columns == [*docs.columns, "shard_"] and back.count() == 41
    assert {tuple(r) for r in back.select("bits", "n_bytes", "shard", "_ROW").collect()} == {("kept",) * 4}
    assert max(r[1] for r in back.groupBy("shard_").sum("n_chars").collect()) <= 300


def test_plan_has_no_python(spark, data):
    plan = X.shards(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
