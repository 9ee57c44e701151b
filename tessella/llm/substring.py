"""Substring dedup: seed and extend.

A repeat of at least ``length`` words holds, in each of its windows of ``length`` words, the same winnowed anchor: the
least hash among the window's runs of ``seed`` words. So documents are joined on anchors:

1. count the anchors; those that occur twice are seeds (others cannot lie in a repeat);
2. extend each occurrence of a seed both ways over the words, to the span of all windows whose anchor it is, and join
   the occurrences by anchor and the words of their spans: each meets the first one that reads the same;
3. where a seed has several spans, which share some windows but not all, match their windows;
4. windows that are not the first of their kind, by document and place, are repeats; overlapping ones merge into
   maximal repeats.

Spans are compared as words, the windows of step 3 by BLAKE2b digests of 128 bits of their words; the anchors' own hash
only decides what meets. Bitmaps of a fixed size thin steps 2 and 3: which anchors may be seeds, which seeds may have
several spans. What they let through by chance, or all anchors once so many repeat that a bitmap is full, costs time and
changes no result.

A long text is worked on in pieces of whole words that overlap by a window; a span that two pieces share is two spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import SLICE_BYTES, arrow_type, dropped, map_texts, text_bytes, written
from .words import bitmap, marked_places

LENGTH = 20
#: Long enough that a seed seldom recurs by chance, however large the corpus is; at most LENGTH.
SEED = 12
#: log2 of the bits in a bitmap: 16 MB at any size of the input.
BITMAP = 27
#: Bytes of a window's digest.
DIGEST = 16


class Winnowed:
    """Of some texts: their words, and the runs of windows that have one anchor, each with its text, first window and number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
        self.data, self.length = data, length
        self.word, self.end, self.first = W.find(data, offsets)
        n = len(self.word) - length + 1
        self.doc = self.start = self.count = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if n <= 0:
            return
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        anchors = W.grams(W.hashes(data, self.word, self.end), seed)
        at = W.leftmost_least(anchors, length - seed + 1)
        inside = np.flatnonzero(of[:n] == of[length - 1 :])
        if not len(inside):
            return
        at, doc = at[inside], of[inside]
        head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
        self.start, self.doc, self.anchor = inside[head], doc[head], anchors[at[head]]
        self.count = np.diff(np.r_[head, len(inside)])

    def spans(self, some: np.ndarray) -> list[bytes]:
        """The words of some runs' spans, joined by one space."""
        size = self.end - self.word + 1
        after = np.cumsum(size)
        before = after - size
        flat = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
        inside = np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
        flat[np.repeat(before, size - 1) + inside] = self.data[np.repeat(self.word, size - 1) + inside]
        raw = flat.tobytes()
        low, high = before[self.start[some]], after[self.start[some] + self.count[some] + self.length - 2] - 1
        return [raw[a:b] for a, b in zip(low.tolist(), high.tolist())]


def winnowed(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> Iterator[tuple[Winnowed, int]]:
    """The texts of a batch with the number of words before each piece; a long text, alone in its batch, comes in pieces."""
    if len(offsets) > 2 or len(data) <= 2 * SLICE_BYTES:
        yield Winnowed(data, offsets, length, seed), 0
        return
    at, before = W.cuts(data, SLICE_BYTES), 0
    for a, b in zip(at, at[1:]):
        own = len(W.find(data[a:b], np.array([0, b - a]))[0])
        # The words of the windows that start in the piece: length - 1 more.
        reach, more = b, 1 << 10
        while reach < len(data):
            reach = min(len(data), b + more)
            _, end, _ = W.find(data[b:reach], np.array([0, reach - b]))
            if len(end) >= length:
                reach = b + int(end[length - 2])
                break
            more *= 2
        piece = Winnowed(data[a:reach], np.array([0, reach - a]), length, seed)
        yield piece, before
        before += own


def _keyed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, key, text)`` and the documents among them.

    The key tells rows with the same id apart by their text; where ids are unique it is a constant, which costs nothing.
    """
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        rows = rows.select("doc_id", F.lit(0).cast("long").alias("key"), "text")
        return rows, rows
    rows = rows.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    return rows, rows.dropDuplicates(["doc_id", "key"])


def _seeds(rows: DataFrame, length: int, seed: int) -> np.ndarray:
    """Bitmap of the anchors that occur at least twice."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [w.anchor for w, _ in winnowed(*text_bytes(b.column(2)), length, seed)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["anchor"])

    return bitmap(map_texts(rows, run, "anchor long", 2).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), BITMAP)


def _occurrences(rows: DataFrame, held, length: int, seed: int) -> DataFrame:
    """``(anchor, span, doc_id, key, start)`` of each occurrence of a seed, extended both ways; ``start`` in words."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for w, before in winnowed(*text_bytes(b.column(2)), length, seed):
            some = marked_places(held.value, w.anchor)
            if len(some):
                parts.append((w.anchor[some], w.spans(some), w.doc[some], w.start[some] - w.first[w.doc[some]] + before))
        if not parts:
            return None
        anchor, span, doc, start = zip(*parts)
        take = pa.array(np.concatenate(doc))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(anchor).view(np.int64)), pa.array([s for x in span for s in x], pa.binary()), b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(start).astype(np.int32))],
            ["anchor", "span", "doc_id", "key", "start"],
        )

    return map_texts(rows, run, f"anchor long, span binary, doc_id {dict(rows.dtypes)['doc_id']}, key long, start int", 2)


def _first(rows: DataFrame, *by: str) -> DataFrame:
    """The first occurrence, by document and place, of each group; copies are joined within tasks before the shuffle."""
    return rows.groupBy(*by).agg(F.min(F.struct("doc_id", "key", "start")).alias("f"))


def _firsts(groups: DataFrame, several: np.ndarray, length: int) -> DataFrame:
    """``(doc_id, key, start, n)``: runs of windows that are the first of their kind, from the first of each span."""
    held = groups.sparkSession.sparkContext.broadcast(several)
    kind, of = dict(groups.dtypes)["doc_id"], arrow_type(groups, "doc_id")

    def split(alone: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                anchor = b.column(0).to_numpy().view(np.uint64)
                take = marked_places(held.value, anchor)
                if alone:
                    take = np.setdiff1d(np.arange(len(anchor)), take)
                rows = b.take(pa.array(take))
                start = rows.column(4).to_numpy()
                if alone:
                    count = [s.count(b" ") + 2 - length for s in rows.column(1).to_pylist()]
                    columns = [rows.column(2), rows.column(3), rows.column(4), pa.array(count, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "start", "n"])
                    continue
                at, shift, digest = [], [], []
                for i, span in enumerate(rows.column(1).to_pylist()):
                    words = span.split(b" ")
                    for k in range(len(words) - length + 1):
                        at.append(i)
                        shift.append(k)
                        digest.append(blake2b(b" ".join(words[k : k + length]), digest_size=DIGEST).digest())
                at = np.array(at, np.int64)
                columns = [rows.column(0).take(pa.array(at)), pa.array(digest, pa.binary()), rows.column(2).take(pa.array(at)).cast(of), rows.column(3).take(pa.array(at)), pa.array((start[at] + np.array(shift, np.int64)).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "digest", "doc_id", "key", "start"])

        return go

    runs = groups.mapInArrow(split(True), f"doc_id {kind}, key long, start int, n int")
    windows = groups.mapInArrow(split(False), f"anchor long, digest binary, doc_id {kind}, key long, start int")
    return runs.union(_first(windows, "anchor", "digest").select("f.*", F.lit(1).alias("n")))


def _judged(docs: DataFrame, doc_id: str, text: str, length: int, seed: int) -> tuple[DataFrame, Callable]:
    """``(doc_id, text, first)``, and the function that finds the repeats of a batch of these texts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows, seen = _keyed(rows)
    seeds = docs.sparkSession.sparkContext.broadcast(_seeds(seen, length, seed))
    found = _first(_occurrences(seen, seeds, length, seed), "anchor", "span").select("anchor", "span", "f.*")
    groups = written(found, "seeds", "zstd")
    several = bitmap(groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), BITMAP)
    first = _firsts(groups, several, length)
    lists = written(first.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("first")), "firsts", "zstd")
    dropped(groups)
    same = rows.doc_id.eqNullSafe(lists.doc_id) & (rows.key == lists.key)
    merged = rows.join(lists, same, "left").select(rows.doc_id, rows.text, lists["first"])

    def repeats(texts: pa.Array, firsts: pa.Array) -> list[list[dict]]:
        """Of each text: windows that hold a seed and are not the first of their kind, merged."""
        own: dict[int, list[np.ndarray]] = {}
        for w, before in winnowed(*text_bytes(texts), length, seed):
            some = marked_places(seeds.value, w.anchor)
            start, count = w.start[some] - w.first[w.doc[some]] + before, w.count[some]
            inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            at, of = np.repeat(start, count) + inside, np.repeat(w.doc[some], count)
            for d, a in zip(np.unique(of).tolist(), np.split(at, np.flatnonzero(np.diff(of)) + 1)):
                own.setdefault(d, []).append(a)
        out = []
        for d in range(len(texts)):
            a = np.concatenate(own[d]) if d in own else np.zeros(0, np.int64)
            if len(a) and firsts[d].is_valid:
                s, n = (firsts[d].values.field(f).to_numpy() for f in ("start", "n"))
                kept = np.repeat(s, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                a = np.setdiff1d(a, kept, assume_unique=True)
            a = np.sort(a)
            cut = np.flatnonzero(np.diff(a) > length)
            out.append([{"start": int(s), "end": int(e) + length} for s, e in zip(a[np.r_[0, cut + 1]], a[np.r_[cut, len(a) - 1]])] if len(a) else [])
        return out

    return merged, repeats


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Documents with what of them repeats: the input's id and text, and ``spans``, an array of ``(start, end)`` in words.

    A span covers windows of ``length`` words that also start earlier: in a smaller id, or earlier in the same
    document. Windows are judged on the input. Null texts have no words; texts of fewer words than ``length`` have
    no spans; null ids come first. Rows with the same id and text count as one document and get the same spans;
    rows with the same id and other texts are ordered by a hash of the text. Other columns are left out.
    """
    merged, repeats = _judged(docs, doc_id, text, length, seed)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(repeats(b.column(1), b.column(2)), kind)], ["doc_id", "text", "spans"])

    return map_texts(merged, run, f"doc_id {dict(merged.dtypes)['doc_id']}, text string, spans array<struct<start:int,end:int>>", 1)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``(doc_id, kept, n_words, n_removed)``: documents without their ``spans``, the kept words joined by one space.

    Null texts have no words and an empty ``kept``; rows with equal ids are rows of their own.
    """
    merged, repeats = _judged(docs, doc_id, text, length, seed)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(b.column(1))
        kept, total, removed = [], [], []
        for s, e, cut in zip(offsets[:-1].tolist(), offsets[1:].tolist(), repeats(b.column(1), b.column(2))):
            own = data[s:e].tobytes().split()
            n = len(own)
            for x in reversed(cut):
                del own[x["start"] : x["end"]]
            kept.append(b" ".join(own))
            total.append(n)
            removed.append(n - len(own))
        texts = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), texts, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])

    return map_texts(merged, run, f"doc_id {dict(merged.dtypes)['doc_id']}, kept string, n_words long, n_removed long", 1)


def digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every document; rows of an empty table are none."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
