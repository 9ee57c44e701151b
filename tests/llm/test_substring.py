import hashlib
import random

import pytest

from tessella.llm import substring


def brute(texts, length=substring.LENGTH):
    seen, out = set(), {}
    for doc_id, text in sorted(texts, key=lambda x: x[0]):
        own = (text or "").encode().split()
        gone = set()
        for i in range(len(own) - length + 1):
            window = tuple(own[i : i + length])
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        kept = b" ".join(w for i, w in enumerate(own) if i not in gone)
        out[doc_id] = (len(own), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(df).collect()}


def test_equals_brute_force_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_overlaps_shifts_and_self_repeats(make):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh")
    passages = [" ".join(f"{word()}{rng.randrange(40)}" for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages).split()
            a = rng.randrange(0, 8)
            parts += p[a : len(p) - rng.randrange(0, 8)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(100, "x " * 100), (101, "x y " * 30), (102, "x " * 25)]
    assert got(make(rows)) == brute(rows)


def test_odd_rows(odd):
    out = got(odd)
    rows = {r.doc_id: r.text for r in odd.collect()}
    assert set(out) == set(rows)
    assert out[5] == out[3] == out[9] == (0, 0, hashlib.sha256(b"").hexdigest())
    assert out[8][1] == 60_000 and out[8][0] == 60_001
    assert substring.digest(odd).count() == odd.count()


def test_same_id_with_other_text(make):
    p = " ".join(f"q{i}" for i in range(25))
    rows = substring.digest(make([(1, p), (1, p + " end"), (2, p)])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 25, 25]


def test_empty_table(make):
    assert got(make([])) == {}


@pytest.mark.parametrize("n", [19, 20, 21])
def test_threshold(make, n):
    p = " ".join(f"q{i}" for i in range(n))
    assert got(make([(1, p), (2, "a " + p + " b")]))[2][1] == (n if n >= 20 else 0)


def test_words_that_polynomial_hashes_confuse(make):
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    rest = " ".join(f"r{i}" for i in range(25))
    rows = [(1, f"{one} {rest}"), (2, f"{one.translate(str.maketrans('ab', 'ba'))} {rest}")]
    assert got(make(rows)) == brute(rows) and got(make(rows))[2][1] == 25


def test_long_texts_in_pieces(make, monkeypatch):
    rng = random.Random(8)
    block = [f"w{rng.randrange(50)}" for _ in range(4000)]
    rows = [(1, " ".join(block)), (2, " ".join(["x", *block[:3000], "y", *block[1000:], *block[:500]])), (3, " ".join(block[2000:2300])), (4, "  ".join(["z"] * 3000))]
    whole = got(make(rows))
    assert whole == brute(rows)
    monkeypatch.setattr(substring, "SLICE_BYTES", 700)
    data = rows[1][1].encode()
    import numpy as np

    pieces = list(substring.winnowed(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 20, 12))
    assert len(pieces) > 20 and sum(int(w.count.sum()) for w, _ in pieces) == len(rows[1][1].split()) - 19
    at = np.concatenate([np.repeat(w.start + before, w.count) + np.arange(int(w.count.sum())) - np.repeat(np.cumsum(w.count) - w.count, w.count) for w, before in pieces])
    assert sorted(at.tolist()) == list(range(len(rows[1][1].split()) - 19))


@pytest.mark.parametrize("bits", [8, 27])
def test_a_full_bitmap_changes_nothing(spark, data, monkeypatch, bits):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(80)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(substring, "BITMAP", bits)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
