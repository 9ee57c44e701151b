"""SimHash near-dedup with vantage-point trees.

A fingerprint is the bitwise majority of its shingles' hashes. Fingerprints link at ``radius`` or fewer differing bits.
If two of 64 bits differ in at most 3, they differ in at most 1 in one of their halves; so there is one tree for
each half, searched with radius 1, and the distance over all bits decides. At a node, what lies within the median distance
of the vantage point goes inside, the rest outside. By the triangle inequality, partners on both sides are at
distances m and m + 1, so what lies at m exactly goes to both sides, and every pair meets in a leaf.

The upper levels, built over a bounded sample, deal the distinct fingerprints into shards; each shard goes on in memory.
Sampling decides where nodes cut, never which pairs are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, map_texts, text_bytes, written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that the upper levels are built over, for each shard; about how many a shard holds; leaves are compared pair by pair.
SAMPLE = 64
SHARD = 1 << 13
LEAF = 256
#: Levels above the shards: 2 ** DEPTH nodes go to every task.
DEPTH = 14


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """Bits set in over half the shingles' XXH64, repeats counted. Fewer words: one shingle of all; none: zero."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashed = xxhash.xxh64_digest
    digests = b"".join([hashed(joined[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    over = 2 * bits.sum(0, dtype=np.int64) > len(bits)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row, ``fp`` the 64 bits as a signed long. Null texts are empty."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, at = text_bytes(b.column(1))
        raw = data.tobytes().lower()
        found = np.array([fingerprint(raw[s:e].split()) for s, e in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_texts(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long", 1)


# Trees --------------------------------------------------------------------------------------------------------------


def _half(values: np.ndarray, tree: int) -> np.ndarray:
    """The bits that a tree measures: low half, high half, or all (2)."""
    if tree == 2:
        return values
    return values & np.uint64(0xFFFFFFFF) if tree == 0 else values >> np.uint64(32)


def _cut(part: np.ndarray, vantage: np.uint64, reach: int) -> tuple[int, np.ndarray] | None:
    """Median distance and the distances; None where the sides would share too much, as in a tight cluster."""
    d = np.bitwise_count(part ^ vantage).astype(np.int64)
    m = int(np.median(d))
    inside, outside = int((d <= m).sum()), int((d > m - reach).sum())
    return (m, d) if max(inside, outside) <= 0.9 * len(d) and inside + outside <= 1.6 * len(d) else None


def build(sample: np.ndarray, tree: int, depth: int, reach: int) -> list[tuple[int, int]]:
    """Nodes of the upper levels in heap order: vantage and median, or median -1 where a node does not cut."""
    rng = np.random.default_rng(tree)
    nodes = [(0, -1)] * (1 << depth)
    todo = [(1, _half(sample, tree))] if depth else []
    while todo:
        at, part = todo.pop()
        if at >= 1 << depth or len(part) < 8:
            continue
        vantage = part[rng.integers(len(part))]
        cut = _cut(part, vantage, reach)
        if cut is None:
            continue
        m, d = cut
        nodes[at] = (int(vantage), m)
        todo += [(2 * at, part[d <= m]), (2 * at + 1, part[d > m])]
    return nodes


def route(values: np.ndarray, tree: int, nodes: list[tuple[int, int]], reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that values fall into, with them; a value near a boundary falls into several."""
    todo = [(1, values)]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if at >= len(nodes) or nodes[at][1] < 0:
            yield at, own
            continue
        vantage, m = nodes[at]
        d = np.bitwise_count(_half(own, tree) ^ np.uint64(vantage))
        todo += [(2 * at, own[d <= m]), (2 * at + 1, own[d > m - reach])]


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label reachable over the pairs (a, b) of places."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _compared(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the radius: each value that has a partner, and the least of its component.

    Values near a pivot are one component already, so in a tight cluster they are compared with the others only.
    """
    label = np.arange(len(values))
    open_ = np.arange(len(values))
    while len(open_) > LEAF:
        d = np.bitwise_count(values[open_] ^ values[open_[0]])
        near = open_[d <= radius]
        rest = open_[d > radius]
        label = _merged(label, np.full(len(near), near[0]), near)
        # Only what is within twice the radius of the pivot can be a partner of what is within the radius.
        border = open_[(d > radius) & (d <= 2 * radius)]
        for i in range(0, len(near), LEAF):
            a, b = np.nonzero(np.bitwise_count(values[near[i : i + LEAF], None] ^ values[None, border]) <= radius)
            if len(a):
                label = _merged(label, near[i + a], border[b])
        open_ = rest
    a, b = np.nonzero(np.bitwise_count(values[open_, None] ^ values[None, open_]) <= radius)
    label = _merged(label, open_[a], open_[b])
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def links(values: np.ndarray, tree: int, radius: int = RADIUS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Links among values that may be partners in a tree's half; as many as values that have a partner in a leaf."""
    rng = np.random.default_rng(seed)
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    todo = [(np.unique(values), tree)]
    while todo:
        own, by = todo.pop()
        if len(own) <= LEAF:
            out.append(_compared(own, radius))
            continue
        reach = radius if by == 2 else radius // 2
        part = _half(own, by)
        cut = next((c for _ in range(4) if (c := _cut(part, part[rng.integers(len(part))], reach))), None)
        if cut is not None:
            m, d = cut
            todo += [(own[d <= m], by), (own[d > m - reach], by)]
        elif by != 2:
            todo.append((own, 2))
        else:
            out.append(_compared(own, radius))
    a, b = (np.concatenate(x) for x in zip(*out))
    return a, b


def linked(fps: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: links that join all distinct fingerprints within the radius, through any chain."""
    reach = radius // 2
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(1, count) / SHARD)))))
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE << depth).toArrow().column(0).to_numpy().view(np.uint64) if depth else np.zeros(0, np.uint64)
    nodes = [build(sample, t, depth, reach) for t in (0, 1)]
    held = fps.sparkSession.sparkContext.broadcast(nodes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            for t, tree in enumerate(held.value):
                for at, part in route(own, t, tree, reach):
                    shard = np.full(len(part), 2 * at + t, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(part.view(np.int64))], ["shard", "fp"])

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        a, b = links(frame["fp"].to_numpy().view(np.uint64), int(key[0]) % 2, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.mapInArrow(deal, "shard long, fp long")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of the nodes of ``(a, b)`` links; the root is the least node reachable.

    Large and small stars by turns (Kiveris et al., "Connected components in MapReduce and beyond", 2014): every
    round is aggregations and joins over the links, written to the shared folder.
    """
    now = written(edges.where("a <> b"), "stars")
    before = None
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        after = written(small, "stars")
        state = after.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        dropped(now)
        now = after
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; the component is the smallest id reachable over links.

    Null and empty texts have the fingerprint zero and link like others. Rows with equal ids stay separate rows; a null id
    is never a component unless no other is reachable. Other columns are left out. An empty table gives none.
    """
    own = written(fingerprints(docs, doc_id, text), "fingerprints")
    groups = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    tree = components(linked(groups.select("fp"), groups.count(), radius))
    named = groups.join(tree, groups.fp == tree.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, the fingerprint as 16 hexadecimal digits."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
