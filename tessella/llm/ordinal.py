"""Quality by ordinal regression on graded ratings: a cumulative-link model over hashed text.

P(grade > k) = logistic(w . x - t_k) with one weight vector for all grades and ordered thresholds t. Features are hashed
words, log-scaled and of unit length, and a few shape measures of the text. The fit is by gradient steps (Adam) over a bounded,
hashed sample of rated rows; scoring is one pass over the texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import map_texts, text_bytes

#: Rated rows that are learned from, at most.
SAMPLE = 12_000
#: Hashed features; the last SHAPES are measures of the text's shape.
BUCKETS = 1 << 16
SHAPES = 8
EPOCHS = 60
RATE = 0.05
RIDGE = 1e-4
#: Probability of at least grade KEEP that a kept document needs.
KEEP = 1
TAIL = 0.5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the sparse features of a batch of texts."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    start, end, first = W.find(low, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashed = W.span_hash(W.prefix_hash(low), start, end) if len(start) else np.zeros(0, np.uint64)
    key = rows.astype(np.int64) * BUCKETS + (hashed >> np.uint64(48)).astype(np.int64) % (BUCKETS - SHAPES)
    key, count = np.unique(key, return_counts=True)
    value = np.log1p(count)
    row, column = key // BUCKETS, key % BUCKETS
    norm = np.sqrt(np.bincount(row, value**2, len(offsets) - 1))
    value = value / norm[row]
    n, words = np.diff(offsets), np.diff(first)
    classes = np.zeros(256, np.int8)
    classes[48:58], classes[65:91], classes[[33, 35, 36, 37, 38, 42, 64, 124]], classes[128:] = 1, 2, 3, 4
    kind = classes[data]
    row_of = np.repeat(np.arange(len(n)), n)
    share = [np.bincount(row_of[kind == k], minlength=len(n)) / np.maximum(n, 1) for k in (1, 2, 3, 4)]
    kinds = np.bincount(row, minlength=len(n)) / np.maximum(words, 1)
    shape = np.stack([*share, kinds, np.log1p(words) / 10, n / np.maximum(words, 1) / 10, (words == 0).astype(float)], 1)
    every = np.arange(len(n))
    return (
        np.concatenate([row, np.repeat(every, SHAPES)]),
        np.concatenate([column, np.tile(np.arange(BUCKETS - SHAPES, BUCKETS), len(n))]),
        np.concatenate([value, shape.ravel()]),
    )


@dataclass
class Model:
    """Grades in order, shared weights, and a threshold between each two grades."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade above each threshold) of each text."""
        row, column, value = features(data, offsets)
        z = np.bincount(row, value * self.weights[column], len(offsets) - 1)
        return _logistic(z[:, None] - self.thresholds[None, :])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit(texts: list[str | None], ratings: list[int], epochs: int = EPOCHS) -> Model:
    """The model of rated texts."""
    each = []
    for t in texts:
        raw = (t or "").encode()
        _, column, value = features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        each.append((column, value))
    return fit_features(each, ratings, epochs)


def fit_features(each: list[tuple[np.ndarray, np.ndarray]], ratings: list[int], epochs: int = EPOCHS) -> Model:
    """The model of at most SAMPLE rated rows of sparse features. One grade only, or none: constant."""
    grades = sorted(set(ratings))
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(BUCKETS), np.zeros(0))
    column = np.concatenate([c for c, _ in each]).astype(np.int64)
    value = np.concatenate([v for _, v in each]).astype(np.float32).astype(np.float64)
    bounds = np.cumsum([0, *(len(c) for c, _ in each)])
    y = np.searchsorted(grades, ratings)
    above = (y[:, None] > np.arange(len(grades) - 1)[None, :]).astype(float)
    base = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    w, t = np.zeros(BUCKETS), -np.log(base / (1 - base))
    params, m, v = np.concatenate([w, t]), np.zeros(BUCKETS + len(t)), np.zeros(BUCKETS + len(t))
    rng, n, step = np.random.default_rng(0), len(y), 0
    size = max(32, n // 12)
    for _ in range(epochs):
        shuffled = rng.permutation(n)
        for at in range(0, n, size):
            pick = shuffled[at : at + size]
            spans = bounds[pick + 1] - bounds[pick]
            places = np.repeat(bounds[pick] - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))
            own = np.repeat(np.arange(len(pick)), spans)
            c, x = column[places], value[places]
            z = np.bincount(own, x * params[c], len(pick))
            # Cumulative likelihood as one logistic loss a threshold: gradients in z and t differ in sign only.
            gap = _logistic(z[:, None] - params[None, BUCKETS:]) - above[pick]
            gradient = np.concatenate([np.bincount(c, x * gap.sum(1)[own], BUCKETS) / len(pick) + RIDGE * params[:BUCKETS], -gap.mean(0)])
            step += 1
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            params = params - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            params[BUCKETS:] = np.maximum.accumulate(params[BUCKETS:])
    return Model(grades, params[:BUCKETS], params[BUCKETS:])


def sample(docs: DataFrame, ratings: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``(text, grade)`` of at most ``size`` rated rows, chosen by a hash of the id; null ids and grades are left out.

    ``ratings`` has ``(doc_id, grade)``; a document rated more than once counts with its lowest grade.
    """
    known = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").select("doc_id", "grade")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(size)
    once = chosen.groupBy(F.col("doc_id").alias("rated")).agg(F.min("grade").alias("grade"))
    return docs.select("doc_id", "text").join(F.broadcast(once), F.col("doc_id") == F.col("rated")).select("doc_id", "text", "grade")


def learn(docs: DataFrame, ratings: DataFrame, size: int = SAMPLE) -> Model:
    """Fit on the driver, which gets the sparse features of the bounded sample; texts are read whole by the tasks."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(b.column(1))
        row, column, value = features(data, offsets)
        order = np.argsort(row, kind="stable")
        at = np.searchsorted(row[order], np.arange(b.num_rows + 1))
        column, value = column[order].astype(np.int32), value[order].astype(np.float32)
        spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
        blobs = [pa.array([x[s:e].tobytes() for s, e in spans], pa.binary()) for x in (column, value)]
        check = [zlib.crc32(data[s:e].tobytes()) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        grade = b.column(2).cast(pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(check, pa.int64()), grade, *blobs], ["doc_id", "check", "grade", "columns", "shares"])

    chosen = sample(docs, ratings, size)
    sparse = map_texts(chosen, run, f"doc_id {dict(chosen.dtypes)['doc_id']}, check long, grade long, columns binary, shares binary", 1)
    got = sparse.toArrow().sort_by([("doc_id", "ascending"), ("check", "ascending"), ("grade", "ascending")])
    arrays = [[np.frombuffer(x.as_buffer(), kind) for x in got.column(name)] for name, kind in (("columns", np.int32), ("shares", np.float32))]
    return fit_features(list(zip(*arrays)), got.column("grade").to_pylist())


def scored(docs: DataFrame, model: Model, keep: int = KEEP, tail: float = TAIL) -> DataFrame:
    """``(doc_id, grade, tail, keep)`` of every row: expected grade, and the probability of at least grade ``keep``.

    Null and empty texts are scored by their shape alone. Rows with equal ids are scored each. Other columns are left out.
    """
    rows = docs.select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        mod = held.value
        over = mod.tails(*text_bytes(b.column(1)))
        expected = mod.grades[0] + over @ np.diff(np.array(mod.grades, float))
        at = int(np.searchsorted(mod.grades, keep))
        p = np.ones(len(over)) if at == 0 else np.zeros(len(over)) if at >= len(mod.grades) else over[:, at - 1]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(expected), pa.array(p), pa.array(p >= tail)], ["doc_id", "grade", "tail", "keep"])

    return map_texts(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, grade double, tail double, keep boolean", 1)


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)`` of labels: 0 for poor texts, 1 for good ones that are toxic, 2 for good ones that aren't.

    A null quality is no rating; a null mark of toxicity is none. Rows without an id stay, for ``sample`` to leave out.
    """
    good = F.when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2)
    return labels.select("doc_id", F.when(F.col("quality") > 0, good).when(F.col("quality").isNotNull(), 0).alias("grade"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, grade, tail, keep)`` of every document, from three grades: its expected grade, and whether it is likely good.

    ``tail`` is the probability of a good text, toxic or not; the expected grade tells these apart as well. Null and empty texts,
    equal and null ids are rows like others. With one grade, or none, scores are constant.
    """
    return scored(docs, learn(docs, graded(labels)))
