import random

from tessella.llm import decontaminate as X


def distance(a, text):
    """Least edits of ``a`` to any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return min(row)


def test_closest():
    rng = random.Random(1)
    for _ in range(200):
        a, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(lo, 50))) for lo in (1, 0))
        assert X.closest(X.masks(a), len(a), t)[0] == min(len(a), distance(a, t))


def test_pieces_cover_the_item():
    for n in (25, 31, 300):
        e = X.budget(n)
        got = X.pieces("x" * n, e)
        assert len(got) == e + 1 and "".join(p for _, p in got) == "x" * n


def _edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[i] = rng.choice("qz")
        elif kind == 1:
            del t[i]
        else:
            t.insert(i, rng.choice("qz"))
    return "".join(t)


def test_equals_brute_force(spark, make):
    rng = random.Random(2)
    item = lambda: " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(6, 16)))
    items = [(i, item()) for i in range(12)] + [(50, None), (51, ""), (52, "short"), (None, "an item without an id at all")]
    rows = []
    for i in range(80):
        parts = [item()]
        for _ in range(rng.randrange(3)):
            t = rng.choice(items[:12])[1]
            parts += [_edited(rng, t, rng.randrange(2 + 2 * X.budget(len(t)))).upper().replace(" ", "\n "), item()]
        rows.append((i, " ".join(parts)))
    rows += [(200, None), (201, ""), (202, items[0][1]), (202, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in rows:
        for k, x in items:
            x = X.normal(x)
            if k is not None and len(x) >= X.SHORTEST and (d := distance(x, X.normal(t))) <= X.budget(len(x)):
                want.add((i, k, d))
    found = [(r.doc_id, r.item_id, r.distance) for r in X.matches(make(rows), bench).collect()]
    assert set(found) == want and len(found) == len(want) + 1
    docs = make(rows)
    left = X.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in rows if i not in {w[0] for w in want})


def test_blocks_lose_nothing(spark, make, monkeypatch):
    items = [(i, f"benchmark item number {i} with some more words {i * 7919}") for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make([(i, f"before {t} after") for i, t in items])
    whole = sorted(tuple(r) for r in X.matches(docs, bench).collect())
    monkeypatch.setattr(X, "BLOCK_CHARS", 100)
    assert sorted(tuple(r) for r in X.matches(docs, bench).collect()) == whole
    more = docs.union(make([(100, "nothing of the kind"), (3, "the same id without an item"), (None, items[8][1]), (None, "no id")]))
    left = sorted(r.text for r in X.clean(more, bench).collect())
    assert left == ["no id", "nothing of the kind", "the same id without an item"]
    assert X.clean(docs, bench.limit(0)).count() == len(items)


def test_real_benchmark_and_odd_rows(spark, data, odd):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}
    found = {(r.doc_id, r.item_id) for r in X.matches(docs, bench).collect()}
    assert exact and exact <= found
    assert X.digest(odd, bench).count() == 0
    assert X.digest(docs, bench.limit(0)).count() == 0 and X.digest(docs.limit(0), bench).count() == 0
    assert X.clean(odd, bench).count() == odd.count()


def test_short_items_and_items_without_id(spark, make):
    items = [(1, "Who wrote  Emma?"), (2, "art"), (3, "日本の首都は?"), (None, "an item of the benchmark without an id"), (4, " "), (None, "who am i")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "so: who wrote\nemma? she"), (2, "who wrote emmas"), (3, "a party, state of"), (4, "a party, art."), (5, "問い:日本の首都は?東京"),
        (6, "here is an item of the benchmark without an id too"), (7, "who wrot emma?"), (8, "(Who am I)"), (9, ""), (10, None),
    ]
    assert sorted((r.doc_id, r.item_id, r.distance) for r in X.matches(make(rows), bench).collect()) == [(1, 1, 0), (4, 2, 0), (5, 3, 0)]
    assert sorted(r.doc_id for r in X.clean(make(rows), bench).collect()) == [2, 3, 7, 9, 10]


def test_items_named_by_strings(spark, make):
    bench = spark.createDataFrame([("q1", "what is the capital of the country in the south"), (None, "art")], "item_id string, text string")
    out = X.digest(make([(1, "so what is the capital of the country in the south?"), (2, "art")]), bench).collect()
    assert [tuple(r) for r in out] == [(1, ["q1"], [0])]


def test_rows_of_one_id_are_kept_apart(make, spark, monkeypatch):
    item, other = "a benchmark item of some length to find", "another benchmark item, longer than a few words"
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    docs = make([(7, item), (7, f"x {item}"), (None, item), (None, f"{other} and {item}"), (3, "nothing of it")])
    want = sorted([(7, (1,), (0,)), (7, (1,), (0,)), (None, (1,), (0,)), (None, (1, 2), (0, 0))], key=repr)
    rows = lambda: sorted(((r.doc_id, tuple(r.item_ids), tuple(r.distances)) for r in X.digest(docs, bench).collect()), key=repr)
    assert rows() == want
    monkeypatch.setattr(X, "BLOCK_CHARS", 10)
    assert rows() == want
