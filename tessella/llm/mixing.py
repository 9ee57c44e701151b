"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Rates r of the documents stay as near as they can, in (bounded) relative entropy, to one copy each, under the
constraint that each source's words sum to its target and no rate exceeds CAP. The solution tilts exponentially in the
document's size: odds r / (CAP - r) = exp(a * size / mean size) / (CAP - 1), with one multiplier a for each source.
Newton's method on the convex dual finds all multipliers at once; each iteration is one aggregation over counts of
(source, size). Rates are then rounded into copies by running totals in order of size, so a source's words miss its
target by about one document.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import columns, dropped, fresh, written

CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Newton steps; what has not converged by then goes on by bisection alone.
NEWTON = 30
#: Largest miss of a source's words, as a part of its words, before rounding.
TOLERANCE = 1e-7
#: Documents of one source and size that are numbered by one task.
BLOCK = 20_000


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """``(doc_id, source, size, tie)`` and ``more`` columns: words of each text, 0 for null, and a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie"), *more)


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``(source, docs, source_size, no, target)`` from ``(source, docs, source_size)``: one row a source.

    Sources in code-point order, null last, get the weights in turn and share all words by them. Targets stop at CAP
    times the source's size; the level at which the others share the rest follows from running sums.
    """
    order = F.create_map(*[F.lit(x) for i, w in enumerate(weights) for x in (i, float(w))])
    numbered = totals.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = numbered.withColumn("weight", order[(F.col("no") - 1) % len(weights)]).withColumn("cap", F.col("source_size") * float(CAP))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "no")
    all_ = Window.partitionBy(F.lit(1))
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    later = by.rowsBetween(0, Window.unboundedFollowing)
    rest = F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    level = weighed.withColumn("level", rest / F.sum("weight").over(later))
    # The first source, by cap over weight, that stays under its cap sets the level.
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("by"), "no", "level"))
    found = level.withColumn("share", F.coalesce(F.min(free).over(all_)["level"], F.lit(0.0)))
    return found.select("source", "docs", "source_size", "no", F.least("cap", F.col("share") * F.col("weight")).alias("target"))


def _rate(a: Column, size: Column, mean: Column) -> Column:
    """CAP times the logistic function; 1 where the multiplier is 0."""
    z = F.least(F.greatest(a * size / mean - math.log(CAP - 1), F.lit(-700.0)), F.lit(700.0))
    return F.lit(float(CAP)) / (F.lit(1.0) + F.exp(-z))


def balance(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """``(no, a, mean, edge)``: multiplier of each source; ``edge`` is the rate where the target is 0 or the cap."""
    cap = F.col("source_size") * float(CAP)
    edge = F.when(F.col("target") <= cap * 1e-12, 0.0).when(F.col("target") >= cap * (1 - 1e-9), float(CAP))
    start = sources.select(
        "no", "target", "source_size", (F.greatest("source_size", F.lit(1)) / F.greatest("docs", F.lit(1))).alias("mean"), edge.alias("edge"),
        F.lit(0.0).alias("a"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("miss"),
    )
    state = written(start, "dual")
    for turn in itertools.count():
        r = _rate(F.col("a"), F.col("size"), F.col("mean"))
        slope = F.col("n") * F.col("size") * F.col("size") / F.col("mean") * r * (F.lit(1.0) - r / CAP)
        sums = (
            counts.join(state.where("edge IS NULL").select("no", "a", "mean"), "no")
            .groupBy("no")
            .agg(F.sum(F.col("n") * F.col("size") * r).alias("words"), F.sum(slope).alias("slope"))
        )
        both = state.join(sums, "no", "left").withColumn("gap", F.col("words") - F.col("target"))
        lo, hi = F.when(F.col("gap") < 0, F.col("a")).otherwise(F.col("lo")), F.when(F.col("gap") > 0, F.col("a")).otherwise(F.col("hi"))
        step = F.col("a") - F.col("gap") / F.when(F.col("slope") > 0, F.col("slope"))
        far = F.when(F.col("gap") < 0, F.abs("a") * 2 + 1).otherwise(-F.abs("a") * 2 - 1)
        middle = F.when((F.col("lo") > float("-inf")) & (F.col("hi") < float("inf")), (F.col("lo") + F.col("hi")) / 2).otherwise(far)
        # A bracket that no number lies inside of is as near as numbers come.
        shut = (F.col("lo") > float("-inf")) & (F.col("hi") < float("inf")) & ((middle <= F.col("lo")) | (middle >= F.col("hi")))
        good = F.lit(turn < NEWTON) & step.isNotNull() & (step > F.col("lo")) & (step < F.col("hi")) & (F.abs(step) < 1e6)
        done = F.col("edge").isNotNull() | (F.abs("gap") <= F.col("source_size") * TOLERANCE)
        moved = both.withColumn("lo", lo).withColumn("hi", hi).select(
            "no", "target", "source_size", "mean", "edge",
            F.when(done, F.col("a")).when(good, step).otherwise(middle).alias("a"), "lo", "hi",
            F.when(done | shut, 0.0).otherwise(1.0).alias("miss"),
        )
        after = written(moved, "dual")
        dropped(state)
        state = after
        if not state.agg(F.sum("miss")).first()[0]:
            break
    return state.select("no", "a", "mean", "edge")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), row: str | None = None) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)`` of every document, and ``row``, a column or ``tie``, if one is named.

    A null source is a source. Documents without words take no part and have no copies; with none that has words all
    targets are 0. Rows with equal ids are rows of their own, ordered by their texts. Copies follow from ids and texts
    alone, so reruns agree. Other columns are left out.
    """
    more = [] if row is None else [row]
    rows = written(sizes(docs, *(c for c in more if c != "tie")), "sizes")
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    sources = written(targets(totals, weights), "targets")
    named = rows.join(sources.select(F.col("source").alias("name"), "no"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    by_size = written(named.groupBy("no", "size").agg(F.count(F.lit(1)).alias("n")), "by_size")
    dual = balance(by_size, sources)
    rate = F.coalesce("edge", _rate(F.col("a"), F.col("size"), F.col("mean")))
    rates = by_size.join(dual, "no").select("no", "size", rate.alias("rate"), (F.floor(F.col("n") / BLOCK) + 1).alias("parts"))
    # The text parts rows that have one id, or none.
    part = F.pmod(F.xxhash64("doc_id", "tie"), F.col("parts"))
    # Written, so that the join's hot sizes can be split, and what follows is dealt by part.
    dealt = written(named.where("size > 0").join(rates, ["no", "size"]).withColumn("part", part), "dealt")
    cells = dealt.groupBy("no", "size", "part").agg(F.count(F.lit(1)).alias("n"), F.first("rate").alias("rate"))
    earlier = Window.partitionBy("no").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.select("no", "size", "part", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(earlier), F.lit(0.0)).alias("before"))
    inside = Window.partitionBy("no", "size", "part").orderBy("doc_id", "tie")
    k = dealt.withColumn("k", F.row_number().over(inside)).join(placed, ["no", "size", "part"])
    up_to = lambda k: F.floor(F.col("before") + k * F.col("rate") + 0.5)
    copies = F.greatest(F.least(up_to(F.col("k")) - up_to(F.col("k") - 1), F.lit(CAP)), F.lit(0)).cast("long")
    chosen = k.select("doc_id", "source", "no", "size", copies.alias("copies"), *more)
    empty = named.where("size = 0").select("doc_id", "source", "no", "size", F.lit(0).cast("long").alias("copies"), *more)
    out = chosen.unionByName(empty).join(sources.select("no", "source_size", "target"), "no")
    out = out.select("doc_id", "source", "size", "source_size", "target", "copies", *more)
    out._tessella_parts = [rows, sources, by_size, dealt]
    return out


def digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every document; null texts have size 0, null sources are one source."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def apply(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it has copies, all columns kept, whatever their names.

    Copies are joined to rows by id and text. Where several rows have the same id and text, all rows are staged with a number
    first and joined by that, so rows with equal or null ids are rows like others.
    """
    tie, many, of = fresh(docs, "_tie"), fresh(docs, "_many"), fresh(docs, "_of")
    count = F.array_repeat(F.lit(0), F.col("copies").cast("int")).alias(many)
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    if docs.groupBy("doc_id", text).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        chosen = mix(docs, row="tie")
        few = written(chosen.where("copies > 0").select(F.col("doc_id").alias(of), F.col("tie").alias(tie), count), "copies")
        own = fresh(docs, "_own")
        joined = docs.withColumn(own, text).join(few, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(own) == F.col(tie)))
    else:
        staged = written(docs.withColumn(tie, F.monotonically_increasing_id()), "numbered")
        chosen = mix(staged, row=tie)
        joined = staged.join(written(chosen.where("copies > 0").select(tie, count), "copies"), tie)
    dropped(*chosen._tessella_parts)
    return joined.select(*columns(docs), F.explode(many).alias(many)).select(*columns(docs))
