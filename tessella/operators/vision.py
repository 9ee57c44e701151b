"""Bag-of-visual-words: codebooks, assignment, histograms and ranked image search."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import dropped, written
from .text_index import postings as number_postings
from .text_search import DIGITS

TOP_K = 15
#: A codebook goes to every task only up to this many numbers; a larger one is assigned in blocks of centres.
BLOCK_NUMBERS = 8_000_000
#: Numbers of the sums by centre that a task keeps before it gives them out.
HELD_NUMBERS = 4_000_000
#: Descriptors are measured in tiles, so that tile times block of centres has at most this many cells at once.
TILE_CELLS = 4_000_000
#: Cells of histograms of a block of images, and of a block of queries, in a batch of searches; small tables have smaller blocks of images.
BLOCK_CELLS = 1 << 17
QUERY_CELLS = 1 << 15
LEAST_BLOCKS = 32


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of the nearest centre, the lowest index on a tie.

    A matrix product finds the candidates; those within rounding of the best are measured exactly.
    """
    rough = (centres**2).sum(1) - 2.0 * (x @ centres.T)
    close = rough <= rough.min(1, keepdims=True) + 1e-6 * (1.0 + np.abs(rough).max(1, keepdims=True))
    row, col = np.nonzero(close)
    exact = np.sqrt(((x[row] - centres[col]) ** 2).sum(1))
    order = np.lexsort((col, exact, row))
    first = order[np.r_[True, np.diff(row[order]) > 0]] if len(order) else order
    return col[first], exact[first]


def _largest_dot(x: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and value of the largest positive dot product, the lowest index on a tie; index 0 where none is."""
    dots = x @ planes.T
    best = dots.argmax(1)
    value = dots[np.arange(len(x)), best]
    return np.where(value > 0, best, 0), value


def _best(x: np.ndarray, ids: np.ndarray, m: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """Centre number and measure of the best centre of a block, in tiles of bounded size."""
    centre, measure = np.empty(len(x), "int32"), np.empty(len(x))
    step = max(1, TILE_CELLS // len(m))
    for i in range(0, len(x), step):
        at, measure[i : i + step] = (_nearest if near else _largest_dot)(x[i : i + step], m)
        centre[i : i + step] = ids[at]
    return centre, measure


class _Blocks:
    """A codebook in blocks of at most BLOCK_NUMBERS numbers, each sent to the tasks by itself.

    Only the length of the first vector and the numbers of the blocks are looked at before; a block is in the driver's
    memory while it is sent. Centre numbers must differ.
    """

    def __init__(self, codebook: DataFrame):
        self.codebook, first = codebook, codebook.select(F.size("centre_vec").alias("n")).first()
        self.dim = max(first.n, 0) if first else 0
        self.step = max(1, BLOCK_NUMBERS // max(self.dim, 1))
        block = F.floor(F.col("centre") / self.step)
        self.numbers = sorted(r.b for r in codebook.select(block.alias("b")).distinct().collect())

    def send(self, number: int):
        own = self.codebook.where((F.col("centre") >= number * self.step) & (F.col("centre") < (number + 1) * self.step))
        got = own.select(F.col("centre").cast("int"), F.col("centre_vec").cast("array<double>")).orderBy("centre").toArrow()
        vectors = got.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim)
        return self.codebook.sparkSession.sparkContext.broadcast((got.column(0).to_numpy(), vectors))


def _search_block(held, dim: int, near: bool, at: int, first: bool):
    """Batches with ``centre`` and ``measure`` of the best so far; column ``at`` has the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = held.value
        for b in batches:
            kept = b.columns if first else b.columns[:-2]
            centre, measure = _best(_vectors(b.column(at), dim), ids, m, near)
            if not first:
                c, v = b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy()
                better = measure < v if near else measure > np.maximum(v, 0.0)
                centre, measure = np.where(better, centre, c), np.where(better, measure, v)
            names = [*b.schema.names[: len(kept)], "centre", "measure"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(centre.astype("int32")), pa.array(measure)], names)

    return run


def placed(descriptors: DataFrame, codebook: DataFrame, technique: str = "kmeans") -> DataFrame:
    """``descriptors`` with ``centre`` and ``measure``: nearest centre, or hyperplane of largest dot product for ``lsh``.

    Descriptors are never shuffled. A codebook of up to BLOCK_NUMBERS numbers goes to the tasks whole; a larger one goes block
    by block, each pass over a written table of the best so far, so tasks and driver hold one block. Null vectors and
    vectors of another length than the codebook's are left out; without centres nothing is placed.
    """
    if technique not in ("kmeans", "lsh"):
        raise ValueError(f"unknown technique {technique!r}")
    blocks = _Blocks(codebook)
    rows = descriptors.where(F.size("vec") == blocks.dim)
    at = rows.columns.index("vec")
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    schema = f"{kinds}, centre int, measure double"
    if not blocks.numbers:
        return rows.where("false").select("*", F.lit(None).cast("int").alias("centre"), F.lit(None).cast("double").alias("measure"))
    for n, number in enumerate(blocks.numbers):
        before, held = rows, blocks.send(number)
        rows = rows.mapInArrow(_search_block(held, blocks.dim, technique == "kmeans", at, n == 0), schema)
        if len(blocks.numbers) > 1:
            rows = written(rows, "minima")
            held.destroy()
            if n:
                dropped(before)
    return rows


def assign(descriptors: DataFrame, codebook: DataFrame, technique: str = "kmeans") -> DataFrame:
    """``(image_id, desc_no, centre, measure)`` as ``placed`` finds them. Every descriptor counts once."""
    rows = descriptors.select("image_id", "desc_no", "vec")
    return placed(rows, codebook, technique).select("image_id", "desc_no", "centre", "measure")


def histogram(assigned: DataFrame) -> DataFrame:
    """``(image_id, centre, tf)`` of the non-zero cells."""
    return assigned.groupBy("image_id", "centre").agg(F.count(F.lit(1)).alias("tf"))


def centre_frequencies(hist: DataFrame) -> DataFrame:
    """``(centre, df)``: images that have the centre."""
    return hist.groupBy("centre").agg(F.count(F.lit(1)).alias("df"))


def histogram_density(hist: DataFrame) -> DataFrame:
    """Non-zero cells, and cells above one, of each image."""
    return hist.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("nonzero"), F.count_if(F.col("tf") > 1).alias("above_one")
    )


def histogram_fingerprint(hist: DataFrame, k: int) -> DataFrame:
    """A string of 0 and 1 over the ``k`` centres of each image, and how many images share it; centres beyond are left out.

    The string is made of the gaps between an image's own centres, in order: linear in k.
    """
    own = hist.where((F.col("centre") >= 0) & (F.col("centre") < k)).groupBy("image_id").agg(F.array_sort(F.collect_set("centre")).alias("own"))
    rest = hist.select("image_id").distinct().join(own, "image_id", "left").select(F.coalesce("own", F.array().cast("array<int>")).alias("own"))
    before = F.concat(F.array(F.lit(-1)), F.col("own"))
    gaps = F.zip_with("own", F.slice(before, 1, F.greatest(F.size("own"), F.lit(1))), lambda c, b: F.concat(F.repeat(F.lit("0"), c - b - 1), F.lit("1")))
    ones = F.when(F.size("own") > 0, F.array_join(gaps, "")).otherwise(F.lit(""))
    return rest.select(F.rpad(ones, k, "0").alias("fingerprint")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("images"))


def labels_needed(hist: DataFrame, query_hist: DataFrame) -> DataFrame:
    """Postings that an image query ``(centre, qf)`` fetches: images of its non-zero centres, summed."""
    asked = query_hist.where("qf > 0").select("centre").distinct()
    return hist.join(asked, "centre", "left_semi").agg(F.count(F.lit(1)).alias("labels_needed"))


def postings(hist: DataFrame) -> DataFrame:
    """``(term, pos, doc_id, tf)`` of a histogram, centres as terms and images as documents, as a text index has them."""
    return number_postings(hist.select(F.col("centre").alias("term"), F.col("image_id").alias("doc_id"), "tf"))


def idf(n: Column, df: Column) -> Column:
    """log10(N / df), with df at least 1."""
    return F.log10(n / F.greatest(df, F.lit(1)))


def _scores(hist: DataFrame, query_hist: DataFrame, stats: DataFrame | None) -> DataFrame:
    """``(query_id, image_id, score)``; query_hist has ``(query_id, centre, qf)``, at most k rows a query."""
    n = hist.agg(F.countDistinct("image_id").alias("n")).scalar()
    df = stats if stats is not None else centre_frequencies(hist)
    weights = df.select("centre", idf(n, F.col("df")).alias("idf"))
    gain = F.col("qf") * (F.lit(1.0) + F.log10("tf")) * F.col("idf")
    return (
        hist.where(F.col("tf") > 0)
        .join(weights, "centre")
        .join(query_hist, "centre")
        .groupBy("query_id", "image_id")
        .agg(F.round(F.sum(gain), DIGITS).alias("score"))
    )


def search(hist: DataFrame, query_hist: DataFrame, k: int | None = TOP_K, stats: DataFrame | None = None) -> DataFrame:
    """The ``k`` best ``(image_id, score)`` for one query histogram ``(centre, qf)``, ties by image_id."""
    found = _scores(hist, query_hist.withColumn("query_id", F.lit(0)), stats).select("image_id", "score")
    return found if k is None else found.orderBy(F.desc("score"), "image_id").limit(k)


def _rounded(score: np.ndarray) -> np.ndarray:
    """``score`` to DIGITS digits as Spark rounds: half up, of the shortest decimal of the number."""
    scaled = score * 10**DIGITS
    out = np.floor(scaled + 0.5) / 10**DIGITS
    unit = Decimal(1).scaleb(-DIGITS)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(score[i]))).quantize(unit, ROUND_HALF_UP))
    return out + 0.0


def _best_of_block(k: int):
    """The ``k`` best images of a block for each query of a block, ties by image_id; a query's scores are one array at a time."""

    def run(images: pa.Table, asked: pa.Table) -> pa.Table:
        ids = pc.unique(images.column("image_id"))
        ids = ids.take(pc.array_sort_indices(ids))
        centre = images.column("centre").to_numpy()
        order = np.argsort(centre, kind="stable")
        centre, gain = centre[order], images.column("gain").to_numpy()[order]
        row = pc.index_in(images.column("image_id"), value_set=ids).to_numpy()[order]
        own = asked.column("query_id").combine_chunks().dictionary_encode()
        number = own.indices.to_numpy(zero_copy_only=False)
        by = np.argsort(number, kind="stable")
        wanted, qf = asked.column("centre").to_numpy()[by], asked.column("qf").to_numpy().astype("float64")[by]
        first, last = np.searchsorted(centre, wanted, "left"), np.searchsorted(centre, wanted, "right")
        ends = np.searchsorted(number[by], np.arange(len(own.dictionary) + 1))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q, (i, j) in enumerate(zip(ends, ends[1:])):
            cells = [slice(first[x], last[x]) for x in range(i, j)]
            rows = np.concatenate([row[c] for c in cells])
            score = np.bincount(rows, np.concatenate([gain[c] * f for c, f in zip(cells, qf[i:j])]), len(ids))
            hit = np.flatnonzero(np.bincount(rows, minlength=len(ids)))
            if len(hit) > k:
                # Rounding moves a score by half a unit at most.
                least = np.partition(score[hit], len(hit) - k)[len(hit) - k] - 2.0 * 10.0**-DIGITS
                hit = hit[score[hit] >= least]
            near = _rounded(score[hit])
            best = np.argsort(-near, kind="stable")[:k]
            found.append((np.full(len(best), q), hit[best], near[best]))
        q, at, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query_id": own.dictionary.take(pa.array(q)), "image_id": ids.take(pa.array(at)), "score": score})

    return run


def search_batch(hist: DataFrame, query_hist: DataFrame, k: int = TOP_K, stats: DataFrame | None = None) -> DataFrame:
    """``(query_id, rank, image_id, score)`` for many query histograms in one job.

    All images are scored for all queries, block by block: a task holds the cells of a block of images and of a block of queries,
    and gives out the ``k`` best of a query in its block, so pairs are neither shuffled nor held.
    """
    hist, query_hist = written(hist, "hist"), written(query_hist, "asked")
    n = hist.agg(F.countDistinct("image_id").alias("n")).scalar()
    df = stats if stats is not None else centre_frequencies(hist)
    weights = df.select("centre", idf(n, F.col("df")).alias("idf"))
    cells, asked = hist.count(), query_hist.count()
    parts = max(min(LEAST_BLOCKS, cells // (BLOCK_CELLS >> 5)), cells // BLOCK_CELLS) + 1
    turns = asked // QUERY_CELLS + 1
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    gain = (F.lit(1.0) + F.log10("tf")) * F.col("idf")
    images = hist.where(F.col("tf") > 0).join(weights, "centre").select(deal("image_id", parts).alias("part"), every(turns).alias("turn"), "image_id", "centre", gain.alias("gain"))
    queries = query_hist.where("qf IS NOT NULL AND centre IS NOT NULL").select(every(parts).alias("part"), deal("query_id", turns).alias("turn"), "query_id", "centre", "qf")
    kinds = f"query_id {dict(query_hist.dtypes)['query_id']}, image_id {dict(hist.dtypes)['image_id']}, score double"
    met = images.groupBy("part", "turn").cogroup(queries.groupBy("part", "turn"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "image_id")
    ranked = met.applyInArrow(_best_of_block(k), kinds).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "image_id", "score")


def first_k_codebook(descriptors: DataFrame, k: int) -> DataFrame:
    """The first ``k`` descriptors by image and number as centres 0 to k-1 (a bounded top-k)."""
    first = descriptors.orderBy("image_id", "desc_no").limit(k).withColumn("_one", F.lit(1))
    order = Window.partitionBy("_one").orderBy("image_id", "desc_no")
    return first.select((F.row_number().over(order) - 1).alias("centre"), F.col("vec").alias("centre_vec"))


def centre_sums(near: DataFrame, dim: int, weight: bool) -> DataFrame:
    """``(centre, at, total, n)``: weighted sums of the vectors of each centre, made inside the tasks."""
    most = max(1, HELD_NUMBERS // max(dim, 1))

    def out(held: dict[int, tuple[np.ndarray, float]]) -> pa.RecordBatch:
        totals = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * dim, pa.int32()), pa.array(np.concatenate([t for t, _ in held.values()]) if held else np.zeros(0)))
        return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), totals, pa.array([n for _, n in held.values()], pa.float64())], ["centre", "total", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, float]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, centre = _vectors(b.column(0), dim), b.column(1).to_numpy()
            w = b.column(2).to_numpy().astype("float64") if weight else np.ones(len(x))
            order = np.argsort(centre, kind="stable")
            ids, first = np.unique(centre[order], return_index=True)
            totals, counts = np.add.reduceat((x * w[:, None])[order], first), np.add.reduceat(w[order], first)
            for c, t, n in zip(ids.tolist(), totals, counts.tolist()):
                old = held.get(c)
                held[c] = (t, n) if old is None else (old[0] + t, old[1] + n)
            if len(held) > most:
                yield out(held)
                held = {}
        yield out(held)

    parts = near.select("vec", "centre", *(["weight"] if weight else [])).mapInArrow(run, "centre int, total array<double>, n double")
    return parts.select("centre", "n", F.posexplode("total").alias("at", "x")).groupBy("centre", "at").agg(F.sum("x").alias("total"), F.sum("n").alias("n"))


def codebook_rows(cells: DataFrame) -> DataFrame:
    """``(centre, centre_vec, n)`` from ``(centre, at, x, n)``."""
    vec = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c.x.cast("float"))
    return cells.groupBy("centre").agg(vec.alias("centre_vec"), F.max("n").alias("n"))


def macqueen(points: DataFrame, codebook: DataFrame) -> DataFrame:
    """One batch as a mean: each centre moves to the mean of itself, ``n`` times (1 if absent), and of the points nearest to it.

    It does not depend on the order of the points; for one point it is MacQueen's rule. Returns ``(centre, centre_vec, n)``.
    """
    weighted = codebook if "n" in codebook.columns else codebook.withColumn("n", F.lit(1).cast("long"))
    parts = centre_sums(placed(points.select("image_id", "desc_no", "vec"), codebook), _Blocks(codebook).dim, False)
    more = parts.select("centre", "at", "total", F.col("n").cast("long").alias("more"))
    old = weighted.select("centre", "n", F.posexplode("centre_vec").alias("at", "x"))
    count = F.col("n") + F.coalesce("more", F.lit(0))
    mean = (F.col("x").cast("double") * F.col("n") + F.coalesce("total", F.lit(0.0))) / count
    return codebook_rows(old.join(more, ["centre", "at"], "left").select("centre", "at", mean.alias("x"), count.alias("n")))


def compactness(assigned: DataFrame) -> DataFrame:
    """Sum of the distances to the nearest centres: the objective of k-means."""
    return assigned.agg(F.round(F.sum("measure"), DIGITS).alias("compactness"))
