"""Runs against a search at every period, and the digest against the contract in plain Python."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import periodic

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(x):
    """All maximal stretches at every distance; of equal stretches the least period stays."""
    x, out = np.asarray(x), {}
    for q in range(1, len(x) // 2 + 1):
        same = np.r_[False, x[:-q] == x[q:], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, end in edges.reshape(-1, 2).tolist():
            length = end - start + q
            if length >= max(12, 2 * q):
                out.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    names = {}
    found = brute([names.setdefault(w, len(names)) for w in words])
    gone = set()
    for s, length, q in found:
        gone.update(range(s + q, s + length))
    best = min(((-length, s, q) for s, length, q in found), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    four = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha256(lines.encode()).hexdigest(), sha256(left.encode()).hexdigest())


def rows_of(df):
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 7)), max_size=12))
def test_runs_of_repeated_parts(parts):
    x = [w for part, times in parts for w in part * times]
    assert periodic.runs(np.array(x, np.int32)) == brute(x)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=90))
def test_runs_over_two_words(x):
    assert periodic.runs(np.array(x, np.int32)) == brute(x)


@pytest.mark.parametrize("p", [1, 2, 5, 6, 7, 14, 15, 30, 31, 100, 333])
@pytest.mark.parametrize("start", [0, 1, 3, 8])
def test_every_scale(p, start):
    """The shortest runs of each period at any place among different words, and a broken one."""
    r = random.Random(p * 10 + start)
    part = [r.randrange(10**6) for _ in range(p)]
    stretch = [part[i % p] for i in range(max(12, 2 * p))]
    noise = list(range(2 * 10**6, 2 * 10**6 + start)), list(range(3 * 10**6, 3 * 10**6 + 9))
    x = [*noise[0], *stretch, *noise[1]]
    assert periodic.runs(np.array(x, np.int32)) == brute(x) == [(start, len(stretch), p)]
    x[start + len(stretch) - 1] = 7 * 10**6
    assert periodic.runs(np.array(x, np.int32)) == brute(x)


def test_words_in_which_runs_overlap_much():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert periodic.runs(np.array(b, np.int32)) == brute(b)
    assert periodic.runs(np.zeros(50_000, np.int32)) == [(0, 50_000, 1)]


def test_digest_equals_contract(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted((contract(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert rows_of(periodic.digest(docs)) == want
    assert sum(w[1] > 0 for w in want) > 10


def test_odd_rows(odd, make):
    small = odd.where("doc_id IS NULL OR doc_id NOT IN (4, 8)")
    assert rows_of(periodic.digest(small)) == sorted((contract(r.doc_id, r.text) for r in small.collect()), key=repr)
    assert periodic.digest(make([])).collect() == []
    assert periodic.digest(odd).count() == odd.count()


def test_collapsed_texts(make):
    docs = make([(1, "x " + "a b c " * 9 + "y"), (1, "no\u0085gap " * 20), (None, None)]).selectExpr("*", "'q' AS runs", "'q' AS collapsed")
    got = {(r.doc_id, r.n_words): (r.collapsed, [tuple(s) for s in r.runs]) for r in periodic.repeats(docs).collect()}
    assert got[1, 29] == ("x a b c y", [(1, 27, 3)])
    assert got[1, 20] == ("no\u0085gap", [(0, 20, 1)])
    assert got[None, 0] == ("", [])
