"""Periodic runs of words: stretches in which words that are a period apart are the same.

Block matching: at each scale, a power of two, the words' numbers are cut into aligned blocks, an automaton of the blocks is
searched across the document, and a block found again at a distance that suits the scale is the seed of a run, which is
extended both ways, word by word. A run of period q that has twice q words, and LEAST at least, repeats an aligned block of
the scale of q at distance q, so none is missed; ``SMALL`` and ``_scales`` say which distances are looked at at which scale.

Blocks that can't be found again near enough (a word of theirs doesn't come again within the scale's distances), and blocks
inside a run that is known already, whose every repeat belongs to it, aren't searched for.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_texts

#: Words that a run has at least.
LEAST = 12
#: Block size with its least and greatest distance. A run of 12 words or more leaves 12 - q for its repeats, which holds an
#: aligned block of 4 up to a period of 5; at 6 only a block of 2.
SMALL = ((2, 6, 6), (4, 1, 14))
#: Words that seeds are first extended by, all at once.
QUICK = 16

SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _scales(n: int) -> Iterator[tuple[int, int, int]]:
    """Block sizes and distances that a document of ``n`` words can have runs at. A block of B lies in any 2B - 1 words."""
    yield from SMALL
    size = 8
    while 2 * size - 1 <= n // 2:
        yield size, 2 * size - 1, 4 * size - 2
        size *= 2


def _gaps(x: np.ndarray) -> np.ndarray:
    """Words until each word comes again; the number of words where it doesn't."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), len(x))
    same = x[order[1:]] == x[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _windows(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Union of ascending intervals."""
    fresh = np.r_[True, starts[1:] > np.maximum.accumulate(ends)[:-1]]
    at = np.flatnonzero(fresh)
    yield from zip(starts[at].tolist(), np.maximum.reduceat(ends, at).tolist())


def _seeds(seq: tuple[int, ...], blocks: np.ndarray, size: int, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and the distances, from ``near`` to ``far``, at which they are found again."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    names: dict[tuple[int, ...], int] = {}
    own = np.empty(len(blocks), np.int64)
    for k, j in enumerate(blocks.tolist()):
        key = seq[j : j + size]
        own[k] = name = names.setdefault(key, len(names))
        if name == len(names) - 1:
            machine.add_word(key, name)
    machine.make_automaton()
    n = len(seq)
    found: list[tuple[int, int]] = []
    for a, b in _windows(blocks + near, np.minimum(blocks + far + size, n)):
        found += [(a + end - size + 1, name) for end, name in machine.iter(seq[a:b])]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none
    places, name = np.array(found, np.int64).T
    # Blocks of one name in ascending order: those of a place are the ones from far to near before it.
    key = own * (n + 1) + blocks
    order = np.argsort(key, kind="stable")
    key = key[order]
    low = np.searchsorted(key, name * (n + 1) + np.maximum(places - far, 0))
    high = np.searchsorted(key, name * (n + 1) + np.maximum(places - near, -1), "right")
    times = np.maximum(high - low, 0)
    taken = np.repeat(low - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
    j = blocks[order[taken]]
    return j, np.repeat(places, times) - j


def _ends(x: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The stretch around ``at`` in which words are the same as ``d`` words later."""
    n, step, high = len(x) - d, 64, at
    while high < n:
        differ = x[high : min(high + step, n)] != x[high + d : min(high + step, n) + d]
        k = int(differ.argmax())
        if differ[k]:
            high += k
            break
        high, step = high + len(differ), 2 * step
    step, low = 64, at
    while low > 0:
        a = max(low - step, 0)
        differ = (x[a:low] != x[a + d : low + d])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            low -= k
            break
        low, step = a, 2 * step
    return low, high


def _promising(x: np.ndarray, j: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
    """Seeds that a few words on either side don't show to be too short."""
    n = len(x)
    matched = np.full(len(j), size)
    for step in (1, -1):
        at = j + size if step > 0 else j - 1
        alive = np.arange(len(j))
        for _ in range(QUICK):
            here = at[alive]
            inside = (here >= 0) & (here + d[alive] < n)
            alive = alive[inside]
            here = here[inside]
            alive = alive[x[here] == x[here + d[alive]]]
            matched[alive] += 1
            at[alive] += step
            if not len(alive):
                break
        matched[alive] = n
    return np.maximum(LEAST - d, d) <= matched


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a sequence of numbers, by start, then period."""
    n = len(x)
    if n < LEAST:
        return []
    seq, gap = tuple(x.tolist()), _gaps(x)
    out: dict[tuple[int, int], int] = {}
    # The run of the least period that reaches furthest at each word.
    period, reach = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for size, near, far in _scales(n):
        m = (n - near) // size
        blocks = np.arange(m) * size
        if not m:
            continue
        wide = gap[: m * size].reshape(m, size).max(1) <= far
        known = (period[blocks] > 0) & (period[blocks] <= size) & (reach[blocks] >= np.minimum(blocks + far + size, n))
        blocks = blocks[wide & ~known]
        if not len(blocks):
            continue
        j, d = _seeds(seq, blocks, size, near, far)
        own = np.maximum(period[j], 1)
        # Where a run of period q spans d words, and q divides d, a stretch of distance d is that run.
        j, d = (v[~((period[j] > 0) & (own < d) & (d % own == 0) & (reach[j] >= j + d))] for v in (j, d))
        good = _promising(x, j, d, size)
        j, d = j[good], d[good]
        order = np.lexsort((j, d))
        last, high, more = 0, -1, []
        for at, q in zip(j[order].tolist(), d[order].tolist()):
            if q == last and at < high:
                continue
            low, high = _ends(x, at, q)
            last = q
            if high - low + q >= max(LEAST, 2 * q):
                more.append((low, high + q, q))
        for low, high_, q in more:
            if out.setdefault((low, high_ - low), q) > q:
                out[low, high_ - low] = q
            better = reach[low:high_] < high_
            period[low:high_][better], reach[low:high_][better] = q, high_
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run is cut to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def repeats(docs: DataFrame, change: Callable[[object, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every row: its runs by start, then period, and its words without the repeats.

    ``change`` gives, for an id and a text's words as numbers, the places of the words to take instead. Null and empty
    texts have no words and no runs. Equal and null ids are rows of their own. Nothing is shuffled; a text is in memory
    once, as its words and their numbers. Other columns are left out.
    """
    rows = docs.select("doc_id", "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, ends, found, texts = [], [0], [], []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            # Bytes are split at the six characters that words do not have, and no others.
            parts = pa.array((text or "").encode().split(), pa.binary())
            ids = parts.dictionary_encode().indices.to_numpy() if len(parts) else np.zeros(0, np.int32)
            if change is not None and len(ids):
                at = change(doc_id, ids)
                parts, ids = parts.take(pa.array(at)), ids[at]
            own = runs(ids)
            counts.append(len(ids))
            found += own
            ends.append(len(found))
            left = parts.filter(pa.array(kept(len(ids), own))) if own else parts
            texts.append(b" ".join(left.to_pylist()).decode())
        start, length, period = zip(*found) if found else ((), (), ())
        spans = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return map_texts(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, {SCHEMA}", 1)


def repeating(doc_id: object, ids: np.ndarray) -> np.ndarray:
    """Places of the words of a document that repeats itself, for a tenth of the ids, by their checksum; else all in order.

    Null ids have no checksum and stay.
    """
    n = len(ids)
    at = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


def digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` of every row, a tenth of the ids made to repeat.

    The four numbers are of the longest run, ties by start, then period; null where there is none.
    """
    found = repeats(docs, repeating)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div (- best.period)").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
