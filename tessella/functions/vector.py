"""Vector expressions in double precision, and codebook generators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spread of the components of random hyperplanes.
SIGMA = 25.0


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column, weight: float = 1.0) -> Column:
    """Squared distance, times a weight where points stand for several."""
    total = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return total if weight == 1.0 else total * F.lit(float(weight))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def gaussian(*parts: Column | int) -> Column:
    """A standard normal number that depends on the parts alone: two uniform numbers of a SHA-256 of their text, by Box and Muller."""
    digest = F.sha2(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"), 256)
    u, v = ((F.conv(F.substring(digest, at, 13), 16, 10).cast("double") + 0.5) / float(1 << 52) for at in (1, 14))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def gaussian_codebook(spark: SparkSession, k: int, dim: int, seed: int = 0, sigma: float = SIGMA) -> DataFrame:
    """``k`` random hyperplanes ``(centre, centre_vec)``, the same for the same seed on any cluster; made in the tasks."""
    planes = spark.range(k).select(F.col("id").cast("int").alias("centre"))
    row = F.col("centre").cast("string")
    axes = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda a: (gaussian(seed, row, a.cast("string")) * F.lit(float(sigma))).cast("float"))
    return planes.select("centre", axes.alias("centre_vec"))
