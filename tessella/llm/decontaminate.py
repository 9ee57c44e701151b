"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs with at most e edits contains one of any e + 1 pieces of it unchanged. So each item is cut into its
error budget plus one pieces, an automaton finds all pieces in one pass over a text, and each hit is verified by
Myers' bit-parallel distance in the window that the piece's place allows.

Benchmarks are stated query sets: items go to the tasks in blocks of at most BLOCK_CHARS characters, one pass over the
documents for each block, so a benchmark of any size is searched whole. Short items are searched as they stand.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import arrow_type, dropped, map_texts, written

#: Edits allowed, as a part of an item's length.
ERRORS = 0.05
#: Shorter items, in normalised characters, would match by chance with edits: they match without any, as whole words.
SHORTEST = 25
#: Scripts without spaces between words: Thai to Lao, Myanmar, Khmer, kana and ideographs.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
BLOCK_CHARS = 16_000_000


def normal(text: str | None) -> str:
    """Lower case, with one space for each run of white space."""
    return " ".join((text or "").lower().split())


def budget(n: int, errors: float = ERRORS) -> int:
    return max(1, int(n * errors))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """Place and text of ``errors + 1`` pieces of nearly equal length."""
    n = len(item)
    cuts = [n * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(item):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def closest(at: dict[str, int], n: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of ``n`` characters to any part of a text, and the part's end (Myers 1999)."""
    mask, top = (1 << n) - 1, 1 << n - 1
    up, down, distance = mask, 0, n
    best = (n, 0)
    for end, ch in enumerate(text, 1):
        eq = at.get(ch, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        plus = (down | ~(across | up)) & mask
        minus = up & across
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus <<= 1
        up = (minus << 1 | ~(across | plus)) & mask
        down = plus & across & mask
        if distance < best[0]:
            best = (distance, end)
    return best


def _of_word(ch: str) -> bool:
    return (ch == "_" or ch.isalnum() or unicodedata.category(ch)[0] == "M") and not any(a <= ord(ch) <= b for a, b in UNSPACED)


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over either end of a part of a text."""
    return not any(0 < at < len(text) and _of_word(text[at - 1]) and _of_word(text[at]) for at in (start, end))


class Matcher:
    """All items' pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS):
        import ahocorasick

        self.items = [(i, t, masks(t), budget(len(t), errors) if len(t) >= SHORTEST else 0) for i, t in items]
        own: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, _, e) in enumerate(self.items):
            for a, piece in pieces(t, e):
                own.setdefault(piece, []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in own.items():
            self.automaton.add_word(piece, (len(piece), places))
        if own:
            self.automaton.make_automaton()

    _last: tuple = ("", None)

    @classmethod
    def of(cls, key: str, items: list[tuple[int, str]], errors: float) -> Matcher:
        """The matcher of a block; a worker keeps the last one."""
        if cls._last[0] != key:
            cls._last = (key, cls(items, errors))
        return cls._last[1]

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``(item, distance, end)`` of the closest occurrence of each item within its budget, in a normalised text."""
        if not self.items:
            return
        tried: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int]] = {}
        for last, (n, places) in self.automaton.iter(text):
            for k, a in places:
                start = last - n + 1 - a
                if (k, start) in tried or best.get(k, (1, 0))[0] == 0:
                    continue
                tried.add((k, start))
                _, item, at, e = self.items[k]
                if not e and not whole_words(text, start, last + 1):
                    continue
                low = max(0, start - e)
                window = text[low : start + len(item) + e]
                there = window.find(item)
                distance, end = (0, there + len(item)) if there >= 0 else closest(at, len(item), window)
                if distance <= e and (distance, low + end) < best.get(k, (e + 1, 0)):
                    best[k] = (distance, low + end)
        for k, (distance, end) in best.items():
            yield self.items[k][0], distance, end


def _blocks(benchmark: DataFrame, named: bool) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one after the other; ``named``: only those with an id."""
    block, size = [], 0
    for r in benchmark.toLocalIterator():
        t = normal(r.text)
        if not t or named and r.item_id is None:
            continue
        if block and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.item_id, t))
        size += len(t)
    yield block


def matched(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """``(doc_id, hits)`` of every row; hits are ``(item_id, distance, end)`` of the items that occur in its text within their budget.

    Case and white space do not count; ``end`` is a place in the normalised text. Items under SHORTEST characters match
    without edits, as whole words. Null and empty texts and items without an id, which no row could name, match nothing. Rows
    with equal or null ids keep their own hits: nothing is joined or grouped. Other columns are left out; an empty benchmark
    matches nothing. Each block of items is one pass; between blocks the rows with their hits so far are written.
    """
    rows = docs.select("doc_id", "text")
    kind, of = dict(rows.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    hit = pa.struct([("item_id", arrow_type(benchmark, "item_id")), ("distance", pa.int32()), ("end", pa.int64())])
    sc = docs.sparkSession.sparkContext
    out, staged = None, None
    for block in _blocks(benchmark.select("item_id", "text"), True):
        held = sc.broadcast(block)

        def run(b: pa.RecordBatch, held=held, key=uuid.uuid4().hex) -> pa.RecordBatch:
            matcher = Matcher.of(key, held.value, errors)
            own = [[dict(zip(("item_id", "distance", "end"), h)) for h in matcher.find(normal(t))] for t in b.column(1).to_pylist()]
            if b.num_columns == 3:
                own = [before + more for before, more in zip(b.column(2).to_pylist(), own)]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.list_(hit))], ["doc_id", "text", "hits"])

        if out is not None:
            before, staged = staged, written(out, "matched")
            if before is not None:
                dropped(before)
        out = map_texts(rows if staged is None else staged, run, f"doc_id {kind}, text string, hits array<struct<item_id: {of}, distance: int, end: bigint>>", 1)
    return out.select("doc_id", "hits")


def matches(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """``(doc_id, item_id, distance, end)``: a row for each hit of ``matched``."""
    return matched(docs, benchmark, errors).select("doc_id", F.inline("hits"))


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """Rows whose own text holds no benchmark item, all columns kept; null ids and equal ids are rows like others, items without an id are items.

    Each block of items is one pass that filters in place: nothing is joined or shuffled. Between blocks the rows left
    are written, so that a task holds one block's automaton at a time.
    """
    at = docs.columns.index("text")
    sc = docs.sparkSession.sparkContext
    out, staged = None, None
    for block in _blocks(benchmark.select("item_id", "text"), False):
        held = sc.broadcast(block)

        def run(b: pa.RecordBatch, held=held, key=uuid.uuid4().hex) -> pa.RecordBatch:
            matcher = Matcher.of(key, held.value, errors)
            return b.filter(pa.array([not any(True for _ in matcher.find(normal(t))) for t in b.column(at).to_pylist()], pa.bool_()))

        if out is not None:
            before, staged = staged, written(out, "decontaminated")
            if before is not None:
                dropped(before)
        out = map_texts(docs if staged is None else staged, run, docs.schema, at)
    return out


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_ids, distances)`` of each row that has an item, items ascending; rows of one id, or none, are rows of their own."""
    pairs = F.array_sort(F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["distance"].alias("distance"))))
    found = matched(docs, benchmark).where(F.size("hits") > 0).select("doc_id", pairs.alias("p"))
    return found.select("doc_id", F.col("p.item_id").alias("item_ids"), F.col("p.distance").alias("distances"))
