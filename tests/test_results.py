"""Binary result files: layouts, commit, overwrite, and a task that fails."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from tessella.sources import results as R


def test_layouts():
    rows = [(7, 1.5), (3, -0.25)]
    assert R.encode(rows, "text") == struct.pack("<QBidid", 2, 1, 7, 1.5, 3, -0.25)
    assert R.encode(rows, "image") == struct.pack("<QQd", 2, 7, 1.5) + struct.pack("<Qd", 3, -0.25)
    assert R.encode(rows, "fused") == struct.pack("<I", 2) + struct.pack("<Id", 7, 1.5) + struct.pack("<Id", 3, -0.25)
    for layout in R.LAYOUTS:
        assert R.decode(R.encode(rows, layout) + b"\0" * 9, layout) == rows and R.decode(R.encode([], layout), layout) == []
    with pytest.raises(ValueError):
        R.decode(R.encode(rows, "image")[:-1], "image")
    with pytest.raises(struct.error):
        R.encode([(2**40, 1.0)], "text")


def test_written_in_order_and_replaced(spark, tmp_path):
    where = str(tmp_path / "r")
    ranking = spark.range(40).select("id", (F.col("id") % 7).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(10)
    R.write_ranking(ranking, where, "fused")
    got = R.read_rankings(spark, where, "fused").orderBy("place").collect()
    assert [(r.id, r.score) for r in got] == [tuple(r) for r in ranking.collect()] and len(os.listdir(where)) == 1
    R.write_ranking(ranking.limit(2), where, "fused", "append")
    assert R.read_rankings(spark, where, "fused").count() == 12
    R.write_ranking(ranking.limit(3), where, "fused", "overwrite")
    assert R.read_rankings(spark, where, "fused").count() == 3 and len(os.listdir(where)) == 1


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    where = str(tmp_path / "r")
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") < 39, F.col("id")).otherwise(F.lit(2**40)).alias("id"), F.lit(1.0).alias("score"))
    with pytest.raises(Exception, match="(?s)format requires|out of range|argument"):
        R.write_ranking(bad, where, "text")
    assert not os.path.exists(where) or os.listdir(where) == []
