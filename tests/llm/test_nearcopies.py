import random

import numpy as np
import pyarrow as pa

from tessella.llm import nearcopies as X


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Rows that stay: of each component at five-word Jaccard 0.8, the least by id (null last)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    return sorted(min((i is None, i or 0) for i, _ in g) for g in groups.values())


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in X.clean(df).collect())


def test_equals_brute_force_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    left = X.clean(docs)
    assert left.columns == docs.columns
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(docs) == want and not {145, 177} & {i for _, i in want}


def test_chains_and_edits_at_the_limit(make, monkeypatch):
    rng = random.Random(3)
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((6, 40, 90)))]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"z{rng.randrange(9)}"
            rows.append((len(rows), " ".join(t + ["the same line ends each of these texts"])))
            base = t if family % 2 else base
    rng.shuffle(rows)
    want = brute(rows)
    assert len(want) < len(rows) - 12
    assert got(make(rows)) == want
    monkeypatch.setattr(X, "COMMON", 1 << 30)
    assert got(make(rows)) == want


def test_empty_table(make):
    assert got(make([])) == []


def test_rows_without_ids_and_with_equal_ids(make, odd):
    text = lambda k: " ".join(f"k{k}x{i}" for i in range(30))
    near = text(1) + " tail"
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (3, near), (7, text(0) + " end"), (None, text(2))]
    left = sorted(r.text for r in X.clean(make(rows)).collect())
    assert left == sorted([near, text(2), text(3), text(4), text(0) + " end"])
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_columns_of_any_name(make):
    docs = make([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "")])
    for name in ("_text", "_row", "_ID", "_h", "row", "node", "h", "a.b"):
        docs = docs.selectExpr("*", f"'kept' AS `{name}`")
    out = X.clean(docs)
    assert out.columns == docs.columns and sorted((r.doc_id, r["_text"], r["a.b"]) for r in out.collect()) == [(1, "kept", "kept"), (3, "kept", "kept")]


def test_simhash_finds_links_that_are_confirmed(make):
    """Links of the trees are candidates: they hold all pairs within the radius, and nothing unconfirmed joins."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join([*base[:k], "edited", *base[k:]]) for k in range(0, 400, 20)] + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(300)) for _ in range(20)]
    sets = X.shingle_sets(pa.array(texts))
    prints = np.array([X.fingerprint(s) for s in sets], np.int64).view(np.uint64)
    for s, p in zip(sets, prints.tolist()):
        assert p == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s))
    near = np.bitwise_count(prints[:20, None] ^ prints[None, :20]) <= 3
    assert near.sum() > 20
    assert got(make(list(enumerate(texts)))) == brute(list(enumerate(texts)))
