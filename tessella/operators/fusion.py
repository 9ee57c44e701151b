"""One ranking from a text and an image ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text_search import DIGITS

TOP_K = 20


def _inverse_square(v: Column) -> Column:
    return (
        F.when(v.isNull(), F.lit(0.0)).when(v == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.when(v != 0, v * v))
    )


def fuse(text: DataFrame, image: DataFrame, mode: str = "score", k: int = TOP_K) -> DataFrame:
    """Fused ``(doc_id, score)`` of two top lists ``(doc_id, score)``.

    The sum of the inverse squares, doubled for ids in both lists. ``score`` squares the scores, so a lower score
    counts more and a zero is infinite; ``rank`` squares the places (inverse square rank). As many rows as the
    shorter list has, at most ``k``. Both inputs are top lists: their windows are bounded by the two limits.
    """
    if mode not in ("score", "rank"):
        raise ValueError(f"unknown mode {mode!r}")
    one = Window.partitionBy(F.lit(1))
    best = one.orderBy(F.desc("score"), "doc_id")

    def side(df: DataFrame, name: str) -> DataFrame:
        value = F.col("score") if mode == "score" else F.row_number().over(best).cast("double")
        return df.select("doc_id", value.alias(name))

    t, i = side(text, "t"), side(image, "i")
    both = F.col("t").isNotNull() & F.col("i").isNotNull()
    total = (_inverse_square(F.col("t")) + _inverse_square(F.col("i"))) * F.when(both, 2.0).otherwise(1.0)
    fused = t.join(i, "doc_id", "full_outer").select(
        "doc_id", F.round(total, DIGITS).alias("score"), F.col("t").isNotNull().alias("in_t"), F.col("i").isNotNull().alias("in_i")
    )
    limit = F.least(F.count_if("in_t").over(one), F.count_if("in_i").over(one), F.lit(k))
    placed = fused.select("doc_id", "score", F.row_number().over(best).alias("place"), limit.alias("most"))
    return placed.where(F.col("place") <= F.col("most")).select("doc_id", "score")


def pair_by_order(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Row n of one list beside row n of the other, both in ascending order of their keys."""
    from .text_index import dense_ids

    a = dense_ids(left.select(F.col(left_key).alias("left")), F.col("left"), name="place")
    b = dense_ids(right.select(F.col(right_key).alias("right")), F.col("right"), name="place")
    return a.join(b, "place").select("place", "left", "right")
