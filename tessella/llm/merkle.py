"""Merkle manifest of a dataset: one tree a group, one tree over the groups' roots, and a proof for every row.

Leaves are range sorted by group and key. The rows of one group in one range partition are a piece; the pieces' counts
give each row its number within its group. A task folds what is complete and aligned of its piece and gives out only the
ragged nodes at the piece's ends; these are shuffled by the coordinate of an ancestor and folded some levels at a
time until every group has its root. Group roots are the leaves of a second tree, made the same way. For the proofs a piece is
folded again and gets the few upper runs that its ends need, so no task holds more than a piece, however large its group.

A node is the SHA-256 of its children's hexadecimal digests, one after the other, at most ARITY of them; a last run with
fewer children, even one, is a node like others. A group of one leaf is its own root.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded_batches, dropped, written

ARITY = 3
#: Rows of a range partition, about; a piece has no more.
PIECE_ROWS = 1 << 17
#: Levels that one shuffle of ragged nodes folds.
STRIDE = 7
#: Proofs that are handed on at once.
PROOFS = 2_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "piece long, grp long, total long, level int, i long, digest string, children array<string>"
_PLACES = pa.schema(
    [("piece", pa.int64()), ("grp", pa.int64()), ("total", pa.int64()), ("level", pa.int32()), ("i", pa.int64())]
    + [("digest", pa.string()), ("children", pa.list_(pa.string()))]
)
STEP = "array<struct<left: string, right: string>>"


def leaf(values: dict[str, Column]) -> Column:
    """Hexadecimal digest of a row: each value with its length in bytes, ``-`` for null, one after the other."""
    parts = []
    for value in values.values():
        shown = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its proof give: each step puts the siblings around what is known and hashes."""
    return F.aggregate(path, start, lambda known, s: F.sha2(F.concat(s["left"], known, s["right"]).cast("binary"), 256))


def _node(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def _sizes(total: int) -> list[int]:
    """Nodes of a tree of ``total`` leaves, level by level up to its root."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def _height(total: Column) -> Column:
    """Level of the root; in integers, as a logarithm may round."""
    powers = [ARITY**n for n in range(40)]
    return reduce(lambda out, n: out + F.when(total > F.lit(n), 1).otherwise(0), powers, F.lit(0))


class _Piece:
    """The nodes that a contiguous piece of a group's leaves completes: ``known[level]`` is the first number and the digests."""

    def __init__(self, first: int, digests: list[str], total: int):
        self.sizes, self.known = _sizes(total), [(first, digests)]
        #: Parents that the piece's leaves are under and that it can't complete: (level, number).
        self.missing: list[tuple[int, int]] = []
        #: Nodes that only such parents read: (level, number, digest).
        self.ragged: list[tuple[int, int, str]] = []
        low, high = first, first + len(digests)
        for level, n in enumerate(self.sizes[:-1]):
            at, own = self.known[level]
            start = -(-at // ARITY)
            stop = -(-n // ARITY) if at + len(own) == n else (at + len(own)) // ARITY
            stop = max(stop, start) if own else start
            made = [_node(own[max(ARITY * p - at, 0) : ARITY * (p + 1) - at]) for p in range(start, stop)]
            inside = (ARITY * start, ARITY * stop) if made else (at, at)
            self.ragged += [(level, at + k, d) for k, d in enumerate(own) if not inside[0] <= at + k < inside[1]]
            low, high = low // ARITY, (high - 1) // ARITY + 1
            self.missing += [(level + 1, p) for p in range(low, high) if not made or not start <= p < stop]
            self.known.append((start, made))

    def top(self) -> str | None:
        own = self.known[-1][1]
        return own[0] if own else None


def _runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Consecutive rows of one key, a table each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), b.num_rows]
        for start, end in zip(edges[:-1], edges[1:]):
            if held and held[-1].column(key)[0].as_py() != keys[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_PLACES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLACES)], schema=_PLACES)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ragged nodes, roots that are known already, and (without a digest) the parents that each piece misses."""
    rows: list[tuple] = []
    for t in _runs(batches):
        piece, grp, total = (t.column(c)[0].as_py() for c in ("piece", "grp", "total"))
        at, digests = t.column("i").to_numpy(), [d.hex() for d in t.column("digest").to_pylist()]
        # A file that was split may bring parts of a piece that do not adjoin: each is folded by itself.
        edges = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
        for start, end in zip(edges[:-1], edges[1:]):
            own = _Piece(int(at[start]), digests[start:end], total)
            rows += [(piece, grp, total, level, i, d, None) for level, i, d in own.ragged]
            rows += [(piece, grp, total, level, i, None, None) for level, i in own.missing]
            if own.top() is not None:
                rows.append((piece, grp, total, len(own.sizes) - 1, 0, own.top(), None))
        if len(rows) > 10_000:
            yield _emit(rows)
            rows = []
    yield _emit(rows)


def _upper(level: int):
    """Fold all nodes under one ancestor at ``level``, or under a lower root: what is made, with its children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            at: dict[tuple[int, int, int], str] = {}
            totals: dict[int, int] = {}
            for grp, total, own, i, d in zip(*(t.column(c).to_pylist() for c in ("grp", "total", "level", "i", "digest"))):
                at[own, grp, i], totals[grp] = d, total
            sizes = {g: _sizes(n) for g, n in totals.items()}
            made: list[tuple] = []
            for l in range(level):
                for grp, p in sorted({(g, i // ARITY) for own, g, i in at if own == l and l < len(sizes[g]) - 1}):
                    places = range(ARITY * p, min(ARITY * (p + 1), sizes[grp][l]))
                    children = [at[l, grp, i] for i in places]
                    at[l + 1, grp, p] = _node(children)
                    made.append((0, grp, totals[grp], l + 1, p, at[l + 1, grp, p], children))
            yield _emit(made)

    return run


class Forest:
    """Trees over the rows of a table: ``leaves`` by piece, ``roots`` of the groups, ``upper`` nodes with their children."""

    def __init__(self, rows: DataFrame, group: list[str], order: list[str], keep: list[str]):
        """``rows`` have ``digest`` (binary) and are told apart by ``group`` and ``order`` together; ``keep`` stays with a leaf."""
        spark = rows.sparkSession
        bounded_batches(spark)
        n = rows.count()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PIECE_ROWS + 1)
        keys = [*group, *order]
        sorted_rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        ranged = written(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "ranged")
        cut = ranged.withColumn("_part", F.shiftright("_place", 33))
        # A row for each group and partition: as many as groups and partitions together.
        counts = cut.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("piece"))
        whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
        before = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        spans = counts.select(
            F.col("_part").alias("_own"), *[F.col(g).alias(f"_{k}") for k, g in enumerate(group)], "piece",
            F.min("piece").over(whole).alias("grp"), F.sum("n").over(whole).alias("total"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        )
        same = F.col("_part") == F.col("_own")
        for k, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"_{k}"))
        number = F.col("before") + F.col("_place") - F.col("piece")
        placed = cut.join(spans, same).select("piece", "grp", "total", number.alias("i"), "digest", *keep)
        self.leaves = written(placed, "leaves")
        dropped(ranged)
        self._fold()

    def _fold(self) -> None:
        sources = self.leaves.select("piece", "grp", "total", "i", "digest").sortWithinPartitions("piece", "i")
        self.ends = written(sources.mapInArrow(_local, _NODES), "ends")
        nodes = self.ends.where("digest IS NOT NULL")
        height = _height(F.col("total"))
        most = self.leaves.agg(F.max(height)).first()[0] or 0
        self.steps: list[DataFrame] = []
        open_ = nodes.where(F.col("level") < height)
        for level in range(STRIDE, most + STRIDE, STRIDE):
            below = open_.where(F.col("level") < level)
            # Blocks of one ancestor; ARITY ** STRIDE nodes at most of the lowest level, and fewer of each other.
            ancestor = F.expr(f"i div cast(pow({ARITY}, {level} - level) as bigint)")
            block = F.xxhash64("grp", ancestor)
            dealt = below.select(block.alias("block"), "grp", "total", "level", "i", "digest").repartition("block").sortWithinPartitions("block")
            step = written(dealt.mapInArrow(_upper(level), _NODES), "upper")
            self.steps.append(step)
            open_ = open_.where(F.col("level") >= level).union(step.where((F.col("level") == level) & (F.col("level") < height)))
        known = reduce(DataFrame.union, self.steps, nodes)
        self.roots = known.where(F.col("level") == height).select("grp", F.col("digest").alias("root"))
        self.runs = known.where("children IS NOT NULL").select("grp", "level", "i", "children")

    def paths(self, beyond: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Each leaf's kept columns with ``path``, its siblings from the leaf's level to the root.

        ``beyond`` has, for each group, ``(grp, above, *more)``: steps that go on beyond the group's root and further columns.
        """
        want = self.ends.where("digest IS NULL").select("piece", "grp", "level", "i")
        given = want.join(self.runs, ["grp", "level", "i"]).select("piece", F.col("level").alias("up"), "i", "children")
        none = {c: F.lit(None).cast(t) for c, t in self.leaves.dtypes}
        leaves = self.leaves.select("piece", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("up"), F.lit(None).cast("array<string>").alias("children"),
                                    *[c for c in self.leaves.columns if c != "piece"])
        uppers = given.select("piece", F.lit(0).alias("kind"), "up", "children", *[F.col("i") if c == "i" else none[c].alias(c) for c in self.leaves.columns if c != "piece"])
        rows = leaves.union(uppers)
        more: list[str] = []
        if beyond is not None:
            # One row for each piece, before its leaves: as many as pieces.
            more = [c for c in beyond.columns if c != "grp"]
            kinds = dict(beyond.dtypes)
            pieces = self.leaves.groupBy("piece").agg(F.min("grp").alias("grp")).join(beyond, "grp")
            rows = rows.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in more]).unionByName(pieces.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        kinds = dict(rows.dtypes)
        out = ", ".join([f"{c} {kinds[c]}" for c in (*keep, *[c for c in more if c != "above"])] + [f"path {STEP}"])
        dealt = rows.repartition("piece").sortWithinPartitions("piece", "kind", "i")
        return dealt.mapInArrow(_prove(list(keep), [c for c in more if c != "above"]), out)


def _prove(keep: list[str], more: list[str]):
    """Paths of a piece's leaves. A piece is folded whole; its proofs go out PROOFS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            kind = t.column("kind").to_numpy()
            n_head = int(np.searchsorted(kind, 1))
            head, body = t.slice(0, n_head), t.slice(n_head)
            if not body.num_rows:
                continue
            runs: dict[tuple[int, int], list[str]] = {}
            above: list[dict] = []
            extra = {c: None for c in more}
            for k in range(n_head):
                if head.column("up")[k].is_valid:
                    runs[head.column("up")[k].as_py(), head.column("i")[k].as_py()] = head.column("children")[k].as_py()
                else:
                    above = head.column("above")[k].as_py()
                    extra = {c: head.column(c)[k] for c in more}
            first, total = body.column("i")[0].as_py(), body.column("total")[0].as_py()
            own = _Piece(first, [d.hex() for d in body.column("digest").to_pylist()], total)
            yield from _proofs(own, runs, above, body, keep, extra)

    return run


def _proofs(own: _Piece, runs: dict, above: list[dict], body: pa.Table, keep: list[str], extra: dict) -> Iterator[pa.RecordBatch]:
    first, n = own.known[0][0], body.num_rows
    lows, lefts, rights = [], [], []
    low, high = first, first + n
    for level, size in enumerate(own.sizes[:-1]):
        at, digests = own.known[level]
        left, right = [], []
        for i in range(low, high):
            p = i // ARITY
            run = runs.get((level + 1, p)) or digests[ARITY * p - at : min(ARITY * (p + 1), size) - at]
            k = i - ARITY * p
            left.append("".join(run[:k]))
            right.append("".join(run[k + 1 :]))
        lows.append(low)
        lefts.append(left)
        rights.append(right)
        low, high = low // ARITY, (high - 1) // ARITY + 1
    begins = np.cumsum([0, *map(len, lefts)])
    flat = lambda own, c: pa.array([s for part in own for s in part] + [s[c] for s in above], pa.string())
    left, right = flat(lefts, "left"), flat(rights, "right")
    depth = len(lefts) + len(above)
    for start in range(0, n, PROOFS):
        i = np.arange(first + start, first + min(start + PROOFS, n))
        at = np.empty((len(i), depth), np.int64)
        for level, begin in enumerate(begins[:-1]):
            at[:, level] = begin + i // ARITY**level - lows[level]
        at[:, len(lefts) :] = begins[-1] + np.arange(len(above))
        taken = pa.array(at.ravel())
        steps = pa.StructArray.from_arrays([left.take(taken), right.take(taken)], ["left", "right"])
        path = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * depth, pa.int32()), steps)
        cut = body.slice(start, len(i))
        kept = [cut.column(c).combine_chunks() for c in keep]
        same = [pa.repeat(v, len(i)) for v in extra.values()]
        yield pa.RecordBatch.from_arrays([*kept, *same, path], [*keep, *extra, "path"])


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", changed: Column | None = None) -> DataFrame:
    """``(key, leaf, changed_leaf, subroot, root, path)`` of every row.

    Leaves ascend by ``key`` within their group, null first; rows of one key ascend by their leaf, and equal rows are leaves of
    their own. A null group is a group, the first. ``path`` has the siblings left and right of each node from the leaf
    up to the root of all. ``changed_leaf`` is the leaf of a changed text, null where that is the same. Other columns are
    ignored; an empty table has no rows.
    """
    values = {f: F.col(f) for f in fields}
    own = leaf(values)
    other = own if changed is None else leaf(values | {"text": changed})
    hashed = docs.select(
        F.col(group).alias("_group"), F.col(key).alias("_key"), F.unhex(own).alias("digest"), F.unhex(F.nullif(other, own)).alias("_changed"),
        F.monotonically_increasing_id().alias("_row"),
    )
    staged = written(hashed, "hashed")
    below = Forest(staged, ["_group"], ["_key", "digest", "_row"], ["_key", "_changed"])
    dropped(staged)
    tops = written(below.roots.select(F.col("grp").alias("_grp"), F.unhex("root").alias("digest")), "roots")
    over = Forest(tops, [], ["_grp"], ["_grp"])
    above = over.paths(keep=("_grp", "digest")).select(F.col("_grp").alias("grp"), F.lower(F.hex("digest")).alias("subroot"), F.col("path").alias("above"))
    beyond = written(above.withColumn("root", over.roots.select("root").scalar()), "beyond")
    found = below.paths(beyond, keep=("_key", "digest", "_changed"))
    return found.select(
        F.col("_key").alias(key), F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("_changed")).alias("changed_leaf"), "subroot", "root", "path"
    )


def digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``: every proof folded again, from a changed leaf for half of the ids.

    Ids with an even checksum have the line feeds of their text deleted before they are folded; null ids and null texts stay.
    """
    text = F.col("text")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    found = manifest(docs, changed=F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = found.withColumn("folded_root", fold(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
