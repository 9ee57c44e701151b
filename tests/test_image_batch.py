"""Batches of image searches block by block against the plain join of the definition."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import vision


def test_blocks_give_what_the_join_gives(spark, monkeypatch):
    r = random.Random(3)
    cells = [(i, c, r.choice((0, 1, 1, 2, 5))) for i in range(120) for c in r.sample(range(12), r.randrange(1, 6))]
    cells += [(i, 20, 1) for i in range(200, 260)]  # equal scores: ties by image
    hist = spark.createDataFrame(cells, "image_id long, centre int, tf long").cache()
    asked = hist.where("image_id % 7 = 0").select(F.concat(F.lit("q"), "image_id").alias("query_id"), "centre", F.col("tf").alias("qf"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "image_id")
    want = vision._scores(hist, asked, None).withColumn("rank", F.row_number().over(order)).where("rank <= 4")
    rows_of = lambda df: sorted(map(tuple, df.select("query_id", "rank", "image_id", "score").collect()))
    for block, turn in ((1 << 17, 1 << 15), (40, 25)):
        monkeypatch.setattr(vision, "BLOCK_CELLS", block)
        monkeypatch.setattr(vision, "QUERY_CELLS", turn)
        got = vision.search_batch(hist, asked, 4)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # Pairs are not made as rows: no join of cells with what is asked.
        assert "FlatMapCoGroupsInArrow" in plan and rows_of(got) == rows_of(want)
    assert vision.search_batch(hist.where("false"), asked).count() == 0
