"""Context-triggered piecewise hashing: fingerprints of texts, and their likeness.

A rolling hash over the last WINDOW bytes ends a piece wherever its low bits are zero, and each piece gives one
character. The block size, a power of two, follows from the length so that a fingerprint has about SPAN characters; it
has more where repetitive text ends more pieces, since the pieces always cover the whole text.
A fingerprint is ``block:pieces:pieces at twice the block``; two are compared by edit distance where their block sizes
are equal or one step apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import SLICE_BYTES, arrow_type, bounded_batches

WINDOW = 7
SPAN = 64
SMALLEST = 1
#: Characters that two fingerprints must share in a row to be alike at all.
COMMON = 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Rows of a bucket of consecutive ids.
BUCKET = 4000
#: Buckets at most, which bounds the bounds that go to the tasks; beyond, buckets grow, and their sorts spill.
MOST_BUCKETS = 1 << 17
#: Ids that are sampled for each bucket.
SAMPLED = 32

_ROLL = np.uint32(0x85EBCA6B)


def _rolling(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of the last WINDOW bytes at each byte, never across the start of a text."""
    b = data.astype(np.uint32) + np.uint32(1)
    out, factor = b.copy(), _ROLL
    for back in range(1, WINDOW):
        out[back:] += np.where(place[back:] >= back, b[:-back], np.uint32(0)) * factor
        with np.errstate(over="ignore"):
            factor = np.uint32(factor * _ROLL)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    out *= np.uint32(0x297A2D39)
    return out ^ out >> np.uint32(15)


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprint of each text; the empty text's is ``0::``."""
    size = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    roll = _rolling(data, np.arange(len(data)) - np.repeat(starts, size)) if len(data) else np.zeros(0, np.uint32)
    prefix = W.prefix_hash(data)

    def pieces(s: int, cuts: np.ndarray, n: int) -> str:
        ends = np.unique(np.append(cuts, n - 1)) + 1 + s
        hashed = W.span_hash(prefix, np.r_[s, ends[:-1]], ends)
        return ALPHABET[(hashed >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    out = []
    for s, n in zip(starts.tolist(), size.tolist()):
        if not n:
            out.append("0::")
            continue
        own = roll[s : s + n]
        k = max(SMALLEST, (max(1, -(-n // SPAN)) - 1).bit_length())
        while k > SMALLEST and np.count_nonzero(own & np.uint32((1 << k) - 1) == 0) < SPAN // 2 - 1:
            k -= 1
        cuts = np.flatnonzero(own & np.uint32((1 << k) - 1) == 0)
        twice = cuts[own[cuts] & np.uint32((2 << k) - 1) == 0]
        out.append(f"{1 << k}:{pieces(s, cuts, n)}:{pieces(s, twice, n)}")
    return out


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance (Myers 1999, Hyyrö 2003: one bit a character of ``a``)."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = mask, 0, len(a)
    for ch in b:
        eq = at.get(ch, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(across | up) & mask
        minus = up & across
        distance += bool(plus & top) - bool(minus & top)
        plus = plus << 1 | 1
        up = (minus << 1 | ~(across | plus)) & mask
        down = plus & across & mask
    return distance


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = min(COMMON, len(a), len(b))
    if not n or {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; equal fingerprints are 1, incompatible block sizes 0."""
    if a == b:
        return 1.0
    (n, a1, a2), (m, b1, b2) = a.split(":"), b.split(":")
    n, m = int(n), int(m)
    if not n or not m:
        return 0.0
    if n == m:
        return max(_alike(a1, b1), _alike(a2, b2))
    return _alike(a1, b2) if n == 2 * m else _alike(a2, b1) if m == 2 * n else 0.0


def with_next(rows: DataFrame) -> DataFrame:
    """``(bucket, guest, doc_id, text)``, partitioned and sorted so that each row is followed by the next document's.

    Ids of any type that sorts are dealt into buckets between ids that a sort over a sample of them found. The first rows of
    a bucket are also guests at the end of the bucket before, and the first of all at the end of the last, so no row
    needs another bucket.
    """
    n, low = rows.agg(F.count(F.lit(1)), F.min("doc_id")).first()
    buckets = min(MOST_BUCKETS, max(1, n // BUCKET))
    bounds = _bounds(rows.where("doc_id IS NOT NULL").select("doc_id"), n, buckets, low)
    nulls = rows.where("doc_id IS NULL").limit(1).count() > 0
    kind = rows.schema["doc_id"].dataType
    # Bounds that are in the plan once, as a table of one row.
    held = rows.sparkSession.createDataFrame([(i + 1, b) for i, b in enumerate(bounds)], T.StructType([T.StructField("no", T.IntegerType()), T.StructField("bound", kind)]))
    sorted_ = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "bound"))), lambda x: x.bound).alias("bounds"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    # A binary search in the bounds: how many are not above the id. Null counts as below all.
    reach = lambda at, step: F.coalesce(F.get("bounds", at + step - 1) <= F.col("doc_id"), F.lit(False))
    own = F.aggregate(steps, F.lit(0), lambda at, step: F.when(reach(at, step), at + step).otherwise(at)) if bounds else F.lit(0)
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(low)
    is_bound = F.coalesce(F.get("bounds", F.col("own") - 1) == F.col("doc_id"), F.lit(False))
    before = F.when(first, F.lit(len(bounds))).when(F.col("own") > 0, F.when(is_bound, F.col("own") - 1))
    places = F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest")))
    dealt = (
        rows.withColumn("bounds", sorted_.scalar())
        .withColumn("own", own)
        .withColumn("before", before)
        .select(F.explode(F.filter(places, lambda p: p.bucket.isNotNull())).alias("p"), "doc_id", "text")
        .select("p.bucket", "p.guest", "doc_id", "text")
    )
    return dealt.repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text")


def _bounds(ids: DataFrame, n: int, buckets: int, low) -> list:
    """Ids that part the table into about ``buckets`` equal parts, ascending, without the lowest."""
    if buckets < 2:
        return []
    sample = ids.sample(min(1.0, SAMPLED * buckets / n), 1).toArrow().column(0)
    found = sample.take(pc.sort_indices(sample)).to_pylist()
    at = [len(found) * i // buckets for i in range(1, buckets)]
    return sorted({found[i] for i in at if found} - {low})


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and their likenesses.

    The edited text ends in the start of the next document's, by ascending id, in place of its last quarter; after the
    last document comes the first. Null texts are empty; null ids come first; rows with equal ids follow each other by
    text. A single document is its own next one; an empty table gives no rows. Ids may be of any type that sorts. Other
    columns are left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = with_next(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    kind = dict(rows.dtypes)["doc_id"]
    arrow = pa.schema([("doc_id", arrow_type(docs, doc_id)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def work(held: list[tuple]) -> pa.RecordBatch | None:
        """Rows of what is held but the last, each with the row after it if that is in its bucket."""
        prints = fingerprints([t.encode() for _, _, _, t in held])
        edited, out = [], []
        for (bucket, guest, i, t), (other, _, _, following), own, next_ in zip(held, held[1:], prints, prints[1:]):
            if guest or bucket != other:
                continue
            k = len(t) // 4
            changed = (t[: len(t) - k] + following[:k]).encode()
            edited.append(changed)
            out.append([i, len(t), hashlib.sha256(changed).hexdigest(), own, "", 0.0, likeness(own, next_)])
        for row, p in zip(out, fingerprints(edited)):
            row[4], row[5] = p, likeness(row[3], p)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for bucket, guest, i, t in zip(*(c.to_pylist() for c in b.columns)):
                if guest and held and held[-1][0] == bucket and held[-1][1]:
                    continue
                held.append((bucket, guest, i, t or ""))
                size += len(t or "")
                if size > SLICE_BYTES:
                    if (found := work(held)) is not None:
                        yield found
                    held, size = held[-1:], 0
        if held and (found := work(held)) is not None:
            yield found

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
