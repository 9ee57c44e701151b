import random

import pytest

from tessella.plans import boolean as B


@pytest.mark.parametrize(
    ("query", "rpn"),
    [
        ("a || b && !c", ["a", "b", "c", "!", "&", "|"]),
        ("(a | b) & c", ["a", "b", "|", "c", "&"]),
        ("a&&b&&c", ["a", "b", "&", "c", "&"]),
        ("!!a", ["a", "!", "!"]),
        ("foo-bar | x_y", ["foo-bar", "x_y", "|"]),
    ],
)
def test_parse(query, rpn):
    assert B.to_rpn(B.parse(query)) == rpn


@pytest.mark.parametrize("query", ["", "a b", "(a", "a)", "&& a", "a &&", "!", "()", "a !b"])
def test_malformed(query):
    with pytest.raises(ValueError):
        B.parse(query)


def test_empty_word():
    assert B.parse("", empty_word="empty") == B.Word("empty")


def test_words_count_repeats_and_negated_words():
    assert B.words(B.parse("a || !a && b")) == {"a": 2, "b": 1}


@pytest.mark.parametrize(("query", "needs"), [("!a", True), ("a && !b", False), ("a || !b", True), ("!(a && b)", True), ("!!a", False)])
def test_needs_universe(query, needs):
    assert B.needs_universe(B.parse(query)) is needs


def _python(query, has):
    return eval(query.replace("&&", "&").replace("||", "|").replace("!", "~"), {}, {w: has(w) for w in "abcd"})  # noqa: S307


def test_random_queries_agree_with_sets():
    rng = random.Random(5)
    universe = frozenset(range(16))
    for _ in range(200):
        q = B.random_query(rng, list("abcd"))
        tree = B.parse(q)
        member = {w: frozenset(i for i in universe if i >> k & 1) for k, w in enumerate("abcd")}

        def fold(t):
            if isinstance(t, B.Word):
                return member[t.term]
            if isinstance(t, B.Not):
                return universe - fold(t.of)
            sets = [fold(p) for p in t.parts]
            return frozenset.intersection(*sets) if isinstance(t, B.And) else frozenset.union(*sets)

        assert {i for i in universe if B.holds(tree, lambda w, i=i: i in member[w])} == fold(tree)


def test_plans_agree_with_sets(spark):
    from tessella.operators import text_search

    rng = random.Random(9)
    rows = [(i, w, 1) for i in range(16) for k, w in enumerate("abcd") if i >> k & 1]
    counts = spark.createDataFrame(rows, "doc_id long, term string, tf int").cache()
    docs = spark.range(16).withColumnRenamed("id", "doc_id")
    queries = [(n, B.random_query(rng, list("abcd"), 2)) for n in range(12)]
    batch = text_search.search_batch(counts, docs, queries, k=100).collect()
    for n, q in queries:
        tree = B.parse(q)
        want = {i for i in range(16) if B.holds(tree, lambda w, i=i: i >> "abcd".index(w) & 1 == 1)}
        assert {r.doc_id for r in batch if r.query_id == n} == want
        if n < 4:
            assert {r.doc_id for r in text_search.search(counts, docs, q, None).collect()} == want
