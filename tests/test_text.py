import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import porter
from tessella.functions import text as X

PAIRS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre",
    "disabled": "disabl", "matting": "mat", "mating": "mate", "meetings": "meet", "day": "dai", "history": "histori",
    "empty": "empti", "is": "is", "go": "go", "a": "a", "ways": "wai", "way": "wai", "relational": "relat",
    "happy": "happi", "sky": "sky", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file",
    "triplicate": "triplic", "electricity": "electr", "hopefulness": "hope", "adoption": "adopt", "controlling": "control",
    "possibly": "possibl", "archaeology": "archaeolog", "2nds": "2nd",
}


@pytest.mark.parametrize(("word", "stem"), PAIRS.items())
def test_stem(word, stem):
    assert porter.stem(word) == stem


def test_tokens_split_at_non_ascii(spark):
    df = spark.createDataFrame([(1, "Café_au-LAIT 42"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", X.tokens("text").alias("t")).collect()}
    assert got == {1: ["caf", "au", "lait", "42"], 2: [], 3: []}


def test_stop_word_meets_query_only_through_variants(spark):
    from tessella.operators import text_search

    docs = spark.createDataFrame([(0, "the way"), (1, "many ways"), (2, "")], "doc_id long, text string")
    stop = X.default_stop_words(spark)
    assert "way" in stop and "ways" not in stop
    counts = X.term_counts(docs, stop)
    find = lambda q: [r.doc_id for r in text_search.search(counts, docs, q, norm=X.query_word).collect()]
    assert find("way") == [1]
    assert find("!way") == [0, 2]


def test_repeated_word_doubles_score_and_unknown_word(spark):
    from tessella.operators import text_search

    docs = spark.createDataFrame([(0, "x y"), (1, "x x z"), (2, "q")], "doc_id long, text string")
    counts = X.term_counts(docs, stemmed=False)
    one, two = (text_search.search(counts, docs, q).collect() for q in ("x", "x || x"))
    assert [(r.doc_id, round(2 * r.score, 5)) for r in one] == [(r.doc_id, round(r.score, 5)) for r in two]
    assert text_search.search(counts, docs, "zzz").count() == 0
    assert text_search.search(counts, docs, "!zzz").count() == 3


def test_stop_words_from_file(spark, tmp_path):
    (tmp_path / "s.txt").write_text("The\n\nof\n")
    assert X.read_stop_words(spark, str(tmp_path)) == ["of", "the"]


def test_extra_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "b b", 3, "x")], "doc_id long, text string, tf int, term string")
    for stemmed in (True, False):
        assert [tuple(r) for r in X.term_counts(df, stemmed=stemmed).collect()] == [(1, "b", 2)]
        assert X.term_counts(df.where(F.lit(False)), stemmed=stemmed).count() == 0


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_dense_ids_of_more_rows_than_the_range_sampler_reads(spark, coalesce):
    from tessella.operators.text_index import dense_ids

    n = 3_000_000
    keys = spark.range(n).select((F.col("id") * 7919 % n).alias("key"), F.lit("x").alias("_at"), F.lit(1).alias("_PART"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        out = dense_ids(keys, F.desc("key"))
        assert out.columns == ["key", "_at", "_PART", "doc_id"]
        low, high, kinds, wrong = out.agg(F.min("doc_id"), F.max("doc_id"), F.count_distinct("doc_id"), F.count_if(F.col("doc_id") != n - 1 - F.col("key"))).first()
        assert (low, high, kinds, wrong) == (0, n - 1, n, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dense_ids(keys.limit(0), F.col("key")).count() == 0


def test_counts_without_stems_shuffle_only_where_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(X, "PART_WORDS", 3)
    texts = ["b a b", None, "", "a " * 7 + "c", "Z z", "b"]
    single = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = X.term_counts(single, stemmed=False)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(0, "a", 1), (0, "b", 2), (3, "a", 7), (3, "c", 1), (4, "z", 2), (5, "b", 1)]
    twice = spark.createDataFrame([(1, "a b"), (1, "b c"), (None, "a"), (None, "a")], "doc_id int, text string")
    got = sorted(map(tuple, X.term_counts(twice, stemmed=False).collect()), key=str)
    assert got == [(1, "a", 1), (1, "b", 2), (1, "c", 1), (None, "a", 2)]


def test_parts_of_a_batch_give_what_the_whole_gives(monkeypatch):
    rows = [["x"] * (i % 5) + [f"w{i % 3}"] for i in range(50)] + [None, [], ["y"] * 40]
    words = pa.array(rows, pa.list_(pa.string()))
    own = lambda a: [sorted((c["term"], c["tf"]) for c in r) for r in a.to_pylist()]
    whole = own(X._counted(words, True))
    for size in (1, 3, 7, 1 << 18):
        monkeypatch.setattr(X, "PART_WORDS", size)
        assert own(X._in_parts(words, True)) == whole
    assert X._in_parts(words.slice(0, 0), True).to_pylist() == []


def test_what_a_python_worker_holds_is_bounded(spark):
    X.term_counts(spark.createDataFrame([(1, "a")], "doc_id int, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == X.BATCH_BYTES
    assert porter.stem.cache_info().maxsize <= 1 << 15
