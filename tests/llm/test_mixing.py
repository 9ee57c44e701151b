import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing


def targets(size):
    """Resharing by rounds, as the contract words it."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, rest, open_ = {}, sum(size.values()), set(names)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = 3 * size[s]
            rest -= out[s]
        open_ -= over
    return out


def check(docs, loose=1.0):
    rows = mixing.mix(docs).collect()
    source = {}
    for r in docs.collect():
        source[r.source] = source.get(r.source, 0) + len(re.findall(mixing.WORD, r.text or ""))
    want = targets(source)
    for s in source:
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {source[s]}
        assert own[0].target == pytest.approx(want[s], abs=1e-6)
        taken = sum(r.copies * r.size for r in own)
        assert abs(taken - want[s]) <= loose * max(r.size for r in own) + 1
        assert all(0 <= r.copies <= 3 for r in own)
    return rows


def test_targets_are_met(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = check(docs)
    assert len(first) == docs.count()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_capped_null_and_wordless_sources(spark):
    rows = [(i, "w " * (i % 7 + 1), "big") for i in range(200)] + [(300 + i, "a b", "tiny") for i in range(5)]
    rows += [(400, None, "void"), (401, "x y z", None), (402, "", "big"), (403, "word " * 5000, "mid"), (404, "q", "mid")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("no", F.lit(1))
    out = check(docs)
    assert len(out) == len(rows)


def test_larger_rates_for_larger_documents_when_tilted_up(spark):
    rows = [(i, "w " * (1 + i % 50), "a") for i in range(500)] + [(1000 + i, "w " * (1 + i % 50), "b") for i in range(500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    mean = lambda lo, hi, s: sum(r.copies for r in out if r.source == s and lo <= r.size < hi) / 200
    assert mean(31, 51, "b") > mean(1, 21, "b") and mean(31, 51, "a") < mean(1, 21, "a")


def test_hot_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = [(i, "same words here", "hot") for i in range(700)] + [(1000 + i, "b " * 5, "cold") for i in range(300)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_odd_rows_and_empty_table(odd, make):
    assert mixing.digest(odd).count() == odd.count()
    assert mixing.digest(make([])).count() == 0
    assert {r.target for r in mixing.digest(make([(1, None), (2, "")])).collect()} == {0.0}


def test_plan_has_no_python(make, spark, data):
    plan = mixing.mix(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_apply_counts_rows_not_ids(spark, make):
    rows = [(None, f"null{i} " * (i % 5 + 1)) for i in range(200)] + [(7, f"seven{i} " * 3) for i in range(100)] + [(7, "same") for _ in range(30)] + [(i, "w " * 4) for i in range(100, 250)] + [(None, None), (None, "")]
    docs = make(rows)
    for name in ("_ID", "_copies", "_copy", "_row", "_many", "tie", "copies", "target", "a.b"):
        docs = docs.withColumn(name, F.lit("kept"))
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    back = out.collect()
    assert {r["_copy"] for r in back} == {r["a.b"] for r in back} == {"kept"}
    words = lambda rows, s: sum(len(r.text.split()) for r in rows if r.source == s and r.text)
    for r in mixing.mix(docs).select("source", "target").distinct().collect():
        assert abs(words(back, r.source) - r.target) <= 6
    assert all(r.text for r in back)
    assert mixing.apply(docs.limit(0)).count() == 0


def test_rates_equal_an_independent_solution(spark):
    """The dual solved by plain bisection."""
    import math

    sizes = {"a": [1 + i % 40 for i in range(400)], "b": [5 + i % 11 for i in range(300)], "c": [100] * 7 + [3] * 50}
    rows = [(s, n) for s, own in sizes.items() for n in own]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(rows)], "doc_id long, text string, source string")
    want = targets({s: sum(own) for s, own in sizes.items()})
    totals = mixing.sizes(docs).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    sources = mixing.targets(totals)
    counts = mixing.sizes(docs).join(sources.select("source", "no"), "source").groupBy("no", "size").agg(F.count(F.lit(1)).alias("n"))
    found = {r.no: r for r in mixing.balance(counts, sources).collect()}
    for r in sources.collect():
        own, mean = sizes[r.source], sum(sizes[r.source]) / len(sizes[r.source])
        rate = lambda a, n: 3 / (1 + 2 * math.exp(-a * n / mean))
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * rate(mid, n) for n in own) < want[r.source] else (lo, mid)
        if found[r.no].edge is None:
            assert found[r.no].a == pytest.approx(lo, abs=1e-4)
        else:
            assert found[r.no].edge == (3.0 if want[r.source] else 0.0)


def test_bisection_alone_converges(spark, data, monkeypatch):
    monkeypatch.setattr(mixing, "NEWTON", 0)
    check(spark.read.parquet(f"{data}/documents.parquet"))
