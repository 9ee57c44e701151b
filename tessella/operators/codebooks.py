"""Codebooks: k-means++ seeding, Lloyd's steps, sequential and incremental k-means.

Points are ``(image_id, desc_no, vec)``, in some functions with a ``weight``; a codebook is ``(centre, centre_vec)``, with ``n`` where
centres have counts. Points are never shuffled; what is, are sums by centre that the tasks have made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import dropped, written
from . import vision

#: Passes over the points that seeding makes at most; more centres than passes are drawn several at a time.
ROUNDS = 32
#: Largest squared shift of a centre at which Lloyd's steps end.
SETTLED = 1.1920929e-07**2


def uniform(*parts: Column | int) -> Column:
    """A number between 0 and 1 that depends on the parts alone: 52 bits of a hash of their text."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _numbered(vectors: DataFrame, *order: str) -> DataFrame:
    """Bounded rows as centres 0, 1, ... in an order."""
    cells = vectors.agg(F.array_sort(F.collect_list(F.struct(*order, "vec"))).alias("c"))
    return cells.select(F.posexplode("c").alias("centre", "r")).select("centre", F.col("r.vec").cast("array<float>").alias("centre_vec"))


def seed_codebook(points: DataFrame, k: int, seed: int = 0, attempt: int = 0) -> DataFrame:
    """``k`` points drawn one after the other, each in proportion to its squared distance from those drawn before.

    The draw is a race: the least of a point's exponential key over its squared distance wins, ties by id, and keys come from
    a hash, so equal inputs draw equal points. Each round is one pass that keeps a task's best. Up to ROUNDS centres come
    one at a time; of more, several of the best in a round, so passes are bounded. Points that coincide with a centre
    are never drawn: there are at most as many centres as different vectors.
    """
    rows = points.select("image_id", "desc_no", "vec").where("vec IS NOT NULL")
    each = -(-k // ROUNDS)
    if 0 < k <= ROUNDS:
        return _frame(points.sparkSession, _seed_books(points, k, seed, [attempt])[0])
    drawn: DataFrame | None = None
    n, turn = 0, 0
    while n < k:
        wait = -F.log(uniform(seed, attempt, turn, F.col("image_id"), F.col("desc_no")))
        if drawn is None:
            raced = rows.select("*", wait.alias("key"))
        else:
            raced = vision.placed(rows, drawn).where("measure > 0").select("image_id", "desc_no", "vec", (wait / (F.col("measure") * F.col("measure"))).alias("key"))
        best = raced.orderBy("key", "image_id", "desc_no").limit(1 if drawn is None else min(each, k - n))
        more = best.select(F.lit(turn).alias("turn"), "key", "image_id", "desc_no", F.col("vec").cast("array<float>").alias("vec"))
        old = None if drawn is None else drawn.select("turn", "key", "image_id", "desc_no", F.col("centre_vec").alias("vec"))
        ranked = written(more if old is None else old.unionByName(more), "drawn")
        order = ("turn", "key", "image_id", "desc_no")
        found = ranked.agg(F.array_sort(F.collect_list(F.struct(*order, "vec"))).alias("c")).select(F.posexplode("c").alias("centre", "r"))
        before = drawn
        drawn = written(found.select("centre", *[F.col(f"r.{c}").alias(c) for c in order], F.col("r.vec").alias("centre_vec")), "seeds")
        dropped(ranked, *([before] if before is not None else []))
        size = drawn.count()
        if size == n:
            break
        n, turn = size, turn + 1
    if drawn is None:
        raise ValueError("k must be 1 or more")
    return drawn.select("centre", "centre_vec")


def _fixed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres as a task measures with: their numbers, and single-precision values."""
    return np.arange(len(x), dtype="int32"), x.astype("float32").astype("float64")


def _races(books: list[np.ndarray | None], open_: list[int]):
    """From ``(image_id, desc_no, vec, wait...)`` with a wait for each open attempt: the rows that win a batch, ``(attempt, key, image_id, desc_no, vec)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = pc.list_value_length(b.column(2)).to_numpy()
            for n, attempt in enumerate(open_):
                own, book = b, books[attempt]
                if book is not None and (length != book.shape[1]).any():
                    own = b.filter(pa.array(length == book.shape[1]))
                key = own.column(3 + n).to_numpy()
                if book is not None and own.num_rows:
                    measure = vision._best(vision._vectors(own.column(2), book.shape[1]), *_fixed(book), True)[1]
                    key = np.divide(key, measure * measure, out=np.full(len(key), np.inf), where=measure > 0)
                key = np.where(np.isfinite(key), key, np.inf)
                best = np.flatnonzero(key == key.min()) if len(key) and np.isfinite(key.min()) else []
                if len(best):
                    won = own.take(pa.array(best))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(best), attempt, "int32")), pa.array(key[best]), *won.columns[:3]], ["attempt", "key", "image_id", "desc_no", "vec"]
                    )

    return run


def _seed_books(points: DataFrame, k: int, seed: int, attempts: list[int]) -> list[np.ndarray]:
    """What ``seed_codebook`` draws one at a time, for several attempts in the same passes, as arrays; ``k`` is at most ROUNDS.

    A pass is one job: tasks measure, race and give out a batch's winners, of which a shuffle of a few rows keeps the first.
    """
    rows = points.select("image_id", "desc_no", "vec").where("vec IS NOT NULL")
    kinds = dict(rows.dtypes)
    schema = f"attempt int, key double, image_id {kinds['image_id']}, desc_no {kinds['desc_no']}, vec {kinds['vec']}"
    books: list[np.ndarray | None] = [None] * len(attempts)
    open_ = list(range(len(attempts)))
    for turn in range(k):
        waits = [(-F.log(uniform(seed, attempts[a], turn, F.col("image_id"), F.col("desc_no")))).alias(f"wait{a}") for a in open_]
        won = rows.select("*", *waits).mapInArrow(_races(books, open_), schema)
        first = won.groupBy("attempt").agg(F.min(F.struct("key", "image_id", "desc_no", F.col("vec").cast("array<float>").alias("vec"))).alias("r"))
        # A row an attempt.
        got = {r.attempt: np.array(r.vec, "float64") for r in first.select("attempt", "r.vec").collect()}
        open_ = [a for a in open_ if a in got]
        for a in open_:
            old = books[a]
            books[a] = got[a][None, :] if old is None else np.r_[old, got[a][None, :]]
        if not open_:
            break
    return [np.zeros((0, 0)) if b is None else b for b in books]


def _book_sums(books: list[np.ndarray], moving: list[int], means: bool):
    """From ``(vec)``: ``(attempt, centre, total, n, cost)``, sums by nearest centre of each moving attempt, a row a task; without ``means`` costs only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {a: np.zeros_like(books[a]) for a in moving}
        counts, costs = {a: np.zeros(len(books[a])) for a in moving}, {a: np.zeros(len(books[a])) for a in moving}
        for b in batches:
            length = pc.list_value_length(b.column(0)).fill_null(-1).to_numpy()
            for a in moving:
                k, dim = books[a].shape
                own = b.column(0) if (length == dim).all() else b.column(0).filter(pa.array(length == dim))
                if not len(own):
                    continue
                x = vision._vectors(own, dim)
                centre, measure = vision._best(x, *_fixed(books[a]), True)
                counts[a] += np.bincount(centre, minlength=k)
                costs[a] += np.bincount(centre, measure * measure, k)
                if means:
                    order = np.argsort(centre, kind="stable")
                    ids, first = np.unique(centre[order], return_index=True)
                    totals[a][ids] += np.add.reduceat(x[order], first)
        for a in moving:
            k, dim = books[a].shape
            lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * dim, pa.int32()), pa.array(totals[a].ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, a, "int32")), pa.array(np.arange(k), pa.int32()), lists, pa.array(counts[a]), pa.array(costs[a])],
                ["attempt", "centre", "total", "n", "cost"],
            )

    return run


def _sums(points: DataFrame, books: list[np.ndarray], moving: list[int], means: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Totals, counts and cost of each moving attempt, after one pass; as many numbers as the codebooks have."""
    parts = points.select("vec").mapInArrow(_book_sums(books, moving, means), "attempt int, centre int, total array<double>, n double, cost double")
    if means:
        cells = parts.select("attempt", "centre", "n", "cost", F.posexplode("total").alias("at", "x"))
    else:
        cells = parts.select("attempt", "centre", "n", "cost", F.lit(0).alias("at"), F.lit(0.0).alias("x"))
    got = cells.groupBy("attempt", "centre", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("cost").alias("cost")).toArrow()
    attempt, centre, at, x, n, cost = (got.column(c).to_numpy() for c in ("attempt", "centre", "at", "x", "n", "cost"))
    out = {}
    for a in moving:
        own, (total, count) = attempt == a, (np.zeros_like(books[a]), np.zeros(len(books[a])))
        total[centre[own], at[own]] = x[own]
        count[centre[own]] = n[own]
        out[a] = total, count, float(cost[own & (at == 0)].sum())
    return out


def _frame(spark: SparkSession, book: np.ndarray) -> DataFrame:
    """A small codebook as a table."""
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(book)], "centre int, centre_vec array<float>")


def _lloyd_books(points: DataFrame, books: list[np.ndarray], max_iter: int) -> list[np.ndarray]:
    """``lloyd`` of several small codebooks in the same passes; a step in which a centre is empty is ``lloyd_step``'s."""
    books, moving = list(books), [a for a, b in enumerate(books) if b.size]
    for _ in range(max_iter):
        if not moving:
            break
        sums = _sums(points, books, moving)
        for a in list(moving):
            total, count, _cost = sums[a]
            old = _fixed(books[a])[1]
            if count.all():
                now = _fixed(total / count[:, None])[1]
            elif count.any():
                step = lloyd_step(points, _frame(points.sparkSession, old)).orderBy("centre")
                now = _fixed(np.array([r.centre_vec for r in step.collect()], "float64"))[1]
            else:
                now = old
            books[a] = now
            if ((now - old) ** 2).sum(1).max() <= SETTLED:
                moving.remove(a)
    return books


def lloyd_step(points: DataFrame, codebook: DataFrame) -> DataFrame:
    """``(centre, centre_vec, n)``: each centre at the (weighted) mean of its points, ``n`` their weight.

    A centre without points takes the point that is farthest from its own centre, the next such centre the next farthest, ties
    by id; its former centre's mean goes without it. Points are taken from centres with more than one of them only.
    """
    weight = "weight" in points.columns
    blocks = vision._Blocks(codebook)
    near = vision.placed(points, codebook)
    sums = written(vision.centre_sums(near, blocks.dim, weight), "sums")
    counts = sums.where("at = 0").select("centre", "n")
    empty = codebook.select("centre").join(counts, "centre", "left_anti")
    wanted = empty.count()
    if wanted:
        w = F.col("weight").cast("double") if weight else F.lit(1.0)
        rich = near.withColumn("w", w).join(counts.withColumnRenamed("n", "all"), "centre").where("all > w AND measure > 0")
        far = rich.orderBy(F.desc("measure"), "image_id", "desc_no").limit(wanted).select(F.lit(-1.0).alias("m") * F.col("measure"), "image_id", "desc_no", "centre", "w", "vec")
        # As many rows as centres are empty.
        taken = far.toArrow().to_pylist()
        free = sorted(r.centre for r in empty.collect())
        left = {r.centre: r.n for r in counts.where(F.col("centre").isin([t["centre"] for t in taken])).collect()} if taken else {}
        moves = []
        for t in taken:
            if left[t["centre"]] - t["w"] > 0 and free:
                left[t["centre"]] -= t["w"]
                to, v = free.pop(0), [float(x) for x in t["vec"]]
                moves += [(t["centre"], a, -x * t["w"], -t["w"]) for a, x in enumerate(v)] + [(to, a, x * t["w"], t["w"]) for a, x in enumerate(v)]
        changes = points.sparkSession.createDataFrame(moves, "centre int, at int, total double, n double")
        sums_ = sums.select("centre", "at", "total", "n").union(changes).groupBy("centre", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    else:
        sums_ = sums
    moved = vision.codebook_rows(sums_.select("centre", "at", (F.col("total") / F.col("n")).alias("x"), "n"))
    still = codebook.join(moved.select("centre"), "centre", "left_anti").select("centre", F.col("centre_vec").cast("array<float>"), F.lit(0.0).alias("n"))
    return moved.unionByName(still) if wanted else moved


def lloyd(points: DataFrame, codebook: DataFrame, max_iter: int = 100) -> DataFrame:
    """Lloyd's steps until no centre moves, or ``max_iter``."""
    book = codebook.select("centre", "centre_vec")
    for _ in range(max_iter):
        moved = written(lloyd_step(points, book).select("centre", "centre_vec"), "codebook")
        shift = F.aggregate(F.zip_with("centre_vec", "old", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda t, x: t + x)
        far = moved.join(book.withColumnRenamed("centre_vec", "old"), "centre").agg(F.max(shift).alias("s")).first().s
        book = moved
        if far is None or far <= SETTLED:
            break
    return book


def kmeans_codebook(points: DataFrame, k: int, seed: int = 0, max_iter: int = 100, attempts: int = 3) -> DataFrame:
    """The best of several runs of seeding and Lloyd's steps: the one with the least sum of squared distances."""
    if k <= ROUNDS and attempts > 0 and "weight" not in points.columns:
        # A small codebook is as many numbers as a few rows: attempts share their passes, and centres go along with the tasks.
        books = _lloyd_books(points, _seed_books(points, k, seed, list(range(attempts))), max_iter)
        held = [a for a, b in enumerate(books) if b.size]
        if not held:
            return seed_codebook(points, k, seed)
        costs = _sums(points, books, held, False)
        return _frame(points.sparkSession, books[min(held, key=lambda a: (costs[a][2], a))])
    best, least = None, None
    for attempt in range(attempts):
        book = lloyd(points, seed_codebook(points, k, seed, attempt), max_iter)
        cost = vision.placed(points.select("image_id", "desc_no", "vec"), book).agg(F.sum(F.col("measure") * F.col("measure")).alias("c")).first().c or 0.0
        if least is None or cost < least:
            best, least = book, cost
    return best


def incremental_step(points: DataFrame, codebook: DataFrame, weight: float | None = None) -> DataFrame:
    """A Lloyd's step over a batch and the earlier centres as points of weight ``weight``, or their ``n``, so that the past counts.

    Ids of the earlier centres as points are -1 and their number. Returns ``(centre, centre_vec, n)``.
    """
    own = F.lit(float(weight)) if weight is not None else F.col("n").cast("double")
    kinds = dict(points.dtypes)
    past = codebook.select(F.lit(-1).cast(kinds["image_id"]).alias("image_id"), F.col("centre").cast(kinds["desc_no"]).alias("desc_no"), F.col("centre_vec").cast(kinds["vec"]).alias("vec"), own.alias("weight"))
    batch = points.select("image_id", "desc_no", "vec", F.lit(1.0).alias("weight"))
    return lloyd_step(batch.unionByName(past), codebook.select("centre", "centre_vec"))


class SequentialKMeans:
    """Sequential k-means over numbered batches, with versions of the centres as tables: ``(centre, centre_vec, n)``.

    The first batch only gives the first centres, its first ``k`` points by id, each with count 1. In a later batch the points
    of a lane are taken one after the other, by id: the nearest centre moves towards the point by one over its count. Lanes are
    independent of the cluster, so a batch is done by many tasks and always in the same way; then each centre gets the mean
    of what the lanes made of it, by their counts. A batch begins with the version before its number and writes its own,
    so a batch that is replayed does nothing twice. The codebook is in each task's memory: at most BLOCK_NUMBERS numbers.
    """

    def __init__(self, spark: SparkSession, path: str, k: int, lanes: int = 64):
        self.spark, self.path, self.k, self.lanes = spark, path.rstrip("/"), k, lanes

    def version(self, number: int | None = None) -> DataFrame | None:
        """The latest version, or the latest before ``number``; none before the first batch."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        whole = [int(n[1:]) for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        done = [v for v in whole if number is None or v < number]
        return self._read(max(done)) if done else None

    def _read(self, number: int) -> DataFrame:
        return self.spark.read.schema("centre int, centre_vec array<double>, n long").parquet(f"{self.path}/v{number}")

    def update(self, points: DataFrame, number: int) -> None:
        """Train with batch ``number``, 0 or more. An empty batch leaves the centres as they are."""
        before = self.version(number)
        if before is None:
            first = points.where("vec IS NOT NULL").orderBy("image_id", "desc_no").limit(self.k).select("image_id", "desc_no", "vec")
            made = _numbered(first, "image_id", "desc_no").select("centre", F.col("centre_vec").cast("array<double>").alias("centre_vec"), F.lit(1).cast("long").alias("n"))
        else:
            made = self._trained(points, before)
        made.write.mode("overwrite").parquet(f"{self.path}/v{number}")

    def _trained(self, points: DataFrame, before: DataFrame) -> DataFrame:
        blocks = vision._Blocks(before)
        if len(blocks.numbers) > 1:
            raise ValueError("the codebook is too large for sequential updates; use macqueen")
        if not blocks.numbers:
            return before
        held, dim = blocks.send(blocks.numbers[0]), blocks.dim
        counts = self.spark.sparkContext.broadcast(np.array([r.n for r in before.orderBy("centre").collect()], "int64"))
        lane = F.pmod(F.conv(F.substring(F.md5(F.col("image_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(self.lanes)).cast("int")
        rows = points.where(F.size("vec") == dim).select(lane.alias("lane"), "image_id", "desc_no", "vec")
        dealt = rows.repartition(self.lanes, "lane").sortWithinPartitions("lane", "image_id", "desc_no")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (ids, start), n0 = held.value, counts.value
            now, c, n = None, start, n0

            def out() -> pa.RecordBatch:
                moved = np.flatnonzero(n != n0)
                # What the lane's points add to the sum of a centre's points.
                more = c[moved] * n[moved, None] - start[moved] * n0[moved, None]
                totals = pa.ListArray.from_arrays(pa.array(np.arange(len(moved) + 1) * dim, pa.int32()), pa.array(more.ravel()))
                return pa.RecordBatch.from_arrays([pa.array(ids[moved]), totals, pa.array((n - n0)[moved])], ["centre", "total", "more"])

            for b in batches:
                for own, x in zip(b.column(0).to_pylist(), vision._vectors(b.column(3), dim)):
                    if own != now:
                        if now is not None:
                            yield out()
                        now, c, n = own, start.copy(), n0.copy()
                    d = c - x
                    j = int((d * d).sum(1).argmin())
                    n[j] += 1
                    c[j] += (x - c[j]) / n[j]
            if now is not None:
                yield out()

        parts = dealt.mapInArrow(run, "centre int, total array<double>, more long").select("centre", F.posexplode("total").alias("at", "x"), "more")
        parts = parts.groupBy("centre", "at").agg(F.sum("x").alias("total"), F.sum("more").alias("more"))
        old = before.select("centre", "n", F.posexplode("centre_vec").alias("at", "x"))
        count = F.col("n") + F.coalesce("more", F.lit(0))
        mean = (F.col("x") * F.col("n") + F.coalesce("total", F.lit(0.0))) / count
        cells = old.join(parts, ["centre", "at"], "left").select("centre", "at", mean.alias("x"), count.alias("n"))
        vec = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s.x)
        return cells.groupBy("centre").agg(vec.alias("centre_vec"), F.max("n").alias("n"))
