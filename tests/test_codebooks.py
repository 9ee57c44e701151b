"""Codebooks against plain versions: seeding, repairs, weights, sequential batches, blocks of a large codebook."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import codebooks, vision
from tessella.streaming import ingest

SCHEMA = "image_id long, desc_no long, vec array<float>"


def points(spark, x, per=4):
    return spark.createDataFrame([(i // per, i % per, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA)


def book_of(df):
    rows = sorted(df.collect())
    return np.array([r.centre_vec for r in rows])


@pytest.fixture
def cloud():
    r = np.random.default_rng(3)
    return np.concatenate([r.normal(c, 0.3, (20, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 5, 0), (5, 5, 5))]).astype("float32")


def plain_seeds(x, k, seed, attempt, per=4):
    u = lambda turn, i: (int(hashlib.md5(f"{seed}:{attempt}:{turn}:{i // per}:{i % per}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    out, d = [], np.ones(len(x))
    for turn in range(k):
        keys = [(-math.log(u(turn, i)) / d[i], i) for i in range(len(x)) if d[i] > 0]
        if not keys:
            break
        c = x[min(keys)[1]].astype("float64")
        own = ((x - c) ** 2).sum(1)
        d = own if not out else np.minimum(d, own)
        out.append(c)
    return np.array(out)


def test_seeding_equals_plain_race(spark, cloud):
    got = book_of(codebooks.seed_codebook(points(spark, cloud), 5, seed=2, attempt=1))
    assert np.allclose(got, plain_seeds(cloud, 5, 2, 1))
    same = np.repeat(cloud[:2], 5, axis=0)
    assert len(book_of(codebooks.seed_codebook(points(spark, same), 6))) == 2


def test_many_seeds_in_few_passes(spark, cloud, monkeypatch):
    monkeypatch.setattr(codebooks, "ROUNDS", 4)
    got = book_of(codebooks.seed_codebook(points(spark, cloud), 20))
    assert len({tuple(r) for r in got.tolist()}) == 20


def test_empty_centres_take_the_farthest_points(spark):
    x = np.array([[0.0], [1.0], [2.0], [10.0], [50.0]], "float32")
    book = spark.createDataFrame([(0, [1.0]), (1, [1000.0]), (2, [2000.0])], "centre int, centre_vec array<float>")
    rows = {r.centre: (r.centre_vec[0], r.n) for r in codebooks.lloyd_step(points(spark, x), book).collect()}
    assert rows == {0: (1.0, 3.0), 1: (50.0, 1.0), 2: (10.0, 1.0)}
    one = codebooks.lloyd_step(points(spark, x[:1]), book)
    assert {r.centre: (r.centre_vec[0], r.n) for r in one.collect()} == {0: (0.0, 1.0), 1: (1000.0, 0.0), 2: (2000.0, 0.0)}


def test_codebook_is_no_worse_than_the_library(spark, data):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from tessella import queries

    x = queries.descriptors(spark, data)
    book = codebooks.kmeans_codebook(x, 8, seed=1, max_iter=15, attempts=2)
    again = codebooks.kmeans_codebook(x, 8, seed=1, max_iter=15, attempts=2)
    assert np.allclose(book_of(book), book_of(again), atol=1e-6) and len(book_of(book)) == 8
    vectors = x.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))
    theirs = KMeans(k=8, seed=1, maxIter=15).fit(vectors).summary.trainingCost
    ours = vision.placed(x, book).agg(F.sum(F.col("measure") ** 2)).first()[0]
    assert ours <= theirs * 1.02


def test_weighted_points(spark):
    x = points(spark, np.array([[0.0], [4.0], [10.0]], "float32"))
    book = spark.createDataFrame([(0, [1.0], 3.0), (1, [9.0], 1.0)], "centre int, centre_vec array<float>, n double")
    got = {r.centre: (round(r.centre_vec[0], 5), r.n) for r in codebooks.incremental_step(x, book).collect()}
    assert got == {0: (round((0 + 4 + 3 * 1) / 5, 5), 5.0), 1: (9.5, 2.0)}
    fixed = {r.centre: r.n for r in codebooks.incremental_step(x, book, weight=10).collect()}
    assert fixed == {0: 12.0, 1: 11.0}


def plain_sequential(x, k, lanes, batches, per=4):
    """``batches`` are lists of image numbers."""
    c = n = None
    for number, images in enumerate(batches):
        own = [i for i in range(len(x)) if i // per in images]
        if number == 0:
            c, n = x[own[:k]].astype("float64"), np.ones(k, int)
            continue
        c0, n0, total, times = c, n, np.zeros_like(c), np.zeros(k, int)
        for lane in range(lanes):
            c, n = c0.copy(), n0.copy()
            for i in own:
                if int(hashlib.md5(str(i // per).encode()).hexdigest()[:8], 16) % lanes == lane:
                    j = ((c - x[i]) ** 2).sum(1).argmin()
                    n[j] += 1
                    c[j] += (x[i] - c[j]) / n[j]
            total += c * n[:, None] - c0 * n0[:, None]
            times += n - n0
        n = n0 + times
        c = (c0 * n0[:, None] + total) / n[:, None]
    return c, n


def test_sequential_batches_and_replay(spark, cloud, tmp_path):
    x, batches = points(spark, cloud), [range(0, 5), range(5, 12), range(12, 13), range(13, 20)]
    trainer = codebooks.SequentialKMeans(spark, str(tmp_path / "t"), 4, lanes=3)
    assert trainer.version() is None
    for number, images in enumerate(batches):
        for _ in range(2):
            trainer.update(x.where(F.col("image_id").isin(list(images))), number)
    c, n = plain_sequential(cloud, 4, 3, batches)
    got = sorted(trainer.version().collect())
    assert np.allclose([r.centre_vec for r in got], c) and [r.n for r in got] == n.tolist()
    trainer.update(x.where("false"), 9)
    assert sorted(trainer.version().collect()) == got


def test_training_stream(spark, cloud, tmp_path):
    x = points(spark, cloud)
    for low in (0, 8, 14):
        x.where((F.col("image_id") >= low) & (F.col("image_id") < {0: 8, 8: 14, 14: 20}[low])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(x.schema).parquet(str(tmp_path / "in"))
        trainer = codebooks.SequentialKMeans(spark, str(tmp_path / "t"), 4, lanes=3)
        ingest.train_codebook(stream, trainer, str(tmp_path / "log"), available_now=True).awaitTermination()
    c, n = plain_sequential(cloud, 4, 3, [range(0, 8), range(8, 14), range(14, 20)])
    assert np.allclose([r.centre_vec for r in sorted(trainer.version().collect())], c)


@pytest.mark.parametrize("technique", ["kmeans", "lsh"])
def test_blocks_of_a_large_codebook(spark, cloud, monkeypatch, technique):
    x = points(spark, cloud)
    book = spark.createDataFrame([(3 * i, [float(v) for v in cloud[i * 5]]) for i in range(16)] + [(90, [float(v) for v in cloud[0]])], "centre int, centre_vec array<float>")
    rows = lambda: sorted(tuple(r) for r in vision.assign(x, book, technique).collect())
    want = rows()
    monkeypatch.setattr(vision, "BLOCK_NUMBERS", 21)
    assert rows() == want and len(want) == len(cloud)
    monkeypatch.undo()
    sums = vision.macqueen(x, book).collect()
    monkeypatch.setattr(vision, "HELD_NUMBERS", 6)
    assert sorted((r.centre, r.n) for r in vision.macqueen(x, book).collect()) == sorted((r.centre, r.n) for r in sums)
    nothing = vision.assign(x, book.where("false"), technique)
    assert nothing.collect() == []


def test_attempts_share_their_passes(spark, cloud):
    x = points(spark, cloud)
    cost = lambda b: ((cloud[:, None].astype("float64") - b[None]) ** 2).sum(2).min(1).sum()
    alone = [book_of(codebooks.lloyd(x, codebooks.seed_codebook(x, 5, 4, attempt), 6)) for attempt in range(2)]
    spark.sparkContext.setJobGroup("kmeans", "kmeans")
    got = book_of(codebooks.kmeans_codebook(x, 5, seed=4, max_iter=6, attempts=2))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert np.allclose(got, min(alone, key=cost), atol=1e-6)
    # Two jobs a pass at most: 5 draws, 6 steps, the costs, and the rows that are returned.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("kmeans")) <= 2 * (5 + 6 + 1) + 2


def test_shared_passes_repair_empty_centres_and_skip_other_lengths(spark, cloud):
    odd = spark.createDataFrame([(900, 0, [1.0]), (901, 0, None)], SCHEMA)
    x = points(spark, cloud).unionByName(odd)
    far = np.concatenate([cloud[:2], [[900.0, 0.0, 0.0]], cloud[50:52]]).astype("float64")
    want = book_of(codebooks.lloyd(points(spark, cloud), codebooks._frame(spark, far), 3))
    got = codebooks._lloyd_books(x, [far, cloud[:3].astype("float64")], 3)
    assert np.allclose(got[0], want, atol=1e-6) and got[1].shape == (3, 3)
    assert len(book_of(codebooks.kmeans_codebook(x, 4, seed=1, max_iter=3, attempts=2))) in (1, 4)
    assert codebooks.kmeans_codebook(x.where("false"), 4).collect() == []
