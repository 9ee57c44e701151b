"""Near copies by shingles of five words, exact at any similarity from SIMILAR up: SimHash, then what SimHash cannot promise.

Each text's fingerprint is the majority of its shingles' hashes, and vantage-point trees find the fingerprints within
RADIUS bits, as in ``simhash``. Similar sets may differ in more bits than any radius that trees can search (about 10 of 64
at the limit, up to 19), so their links are completed exactly: two sets with Jaccard similarity t or more share one of the
first n - ceil(t n) + 1 members of either in any one order of all members (prefix filter). So texts meet in the groups
of their prefixes' shingles as well, and all that meets is confirmed by the sets themselves. Counts over a fixed share of all
texts put common shingles last in the order, which keeps groups as small in a large table as in a small one; they never
decide which pairs are found.

Each text is compared first with the candidate of SimHash and with the least text of most of its groups, one pair each,
then, in turns that go on while they find much, with texts drawn from its groups, so that large clusters become one component in linear work;
what these links leave in several components of a group is then compared across components, all of it. Pairs must share enough of
their prefixes: of two similar sets, the one whose prefix ends first in the order has all it shares of that prefix
in the other's prefix as well, and it can miss only what similarity lets it miss. So passages that many texts share do
not make pairs. Groups are joins that can be split, never one row; texts are read again only for pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .simhash import RADIUS, components, linked
from .store import columns, dropped, fresh, map_texts, text_bytes, written
from .words import bitmap, marked_places

SHINGLE = 5
#: Least similarity of near copies, as a fraction: 4 / 5.
SIMILAR = (4, 5)
#: Rows that tell which shingles are common: one in SHARE of all, however many, and at least SAMPLE.
SHARE = 6
SAMPLE = 1 << 13
#: Of those, the rows that have a common shingle. Each further level of common ones occurs twice as often; half as many can.
COMMON = 3
LEVELS = 10
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Least and most bits of a set's parities, powers of two, by its size: whether it has an odd number of shingles in each of so many buckets.
PARITIES = (256, 4096)
#: Most turns in which each set is compared with a few drawn from its groups, before groups are compared across components,
#: and the share of what a turn draws that must turn out similar for another turn to be worth its jobs.
TURNS = 8
WORTH = 0.1
#: From the second turn on a group is drawn from in parts, by so many more bits of the parities each turn, up to the most.
PART_BITS = (4, 8)
#: log2 of the bits of the bitmap of prefix shingles that several sets have: 16 MB at any size of the input.
BITMAP = 27


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Ascending hashes of each text's shingles, without case; fewer words are one shingle, no words none."""
    data, at = text_bytes(column)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    start, end, first = W.find(data, at)
    words = W.hashes(data, start, end)
    runs = W.grams(words, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        out.append(np.unique(runs[a : b - SHINGLE + 1]) if n >= SHINGLE else W.mix(W.grams(words[a:b], n) + np.uint64(n)) if n else runs[:0])
    return out


def _name(own: np.ndarray) -> int:
    """One number for a set of shingles."""
    return int(W.mix(np.array([W.mix(own).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)).view(np.int64)[0])


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed number; zero for no words."""
    over = np.zeros(64, np.int64)
    for i in range(0, len(own), CHUNK):
        over += np.unpackbits(own[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * over > len(own)).view(np.int64)[0])


def prefix(own: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The shingles of which similar sets share one: the rarest first, by level, then by hash."""
    n = len(own)
    p = n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1 if n else 0
    at = np.zeros(n, np.int8)
    for marked in levels:
        at[marked_places(marked, own)] += 1
    return own[np.argsort(at, kind="stable")[:p]]


def _common(rows: DataFrame) -> list[np.ndarray]:
    """Bitmaps of common shingles, each level's in the one before, whose size does not grow with the input.

    A share of all rows is counted, so a shingle that is not marked is in about as many texts at any size of the input. A bit
    that several shingles have puts rare ones among the common; any order of all shingles finds the same pairs.
    """
    n = rows.count()
    if not n:
        return []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(b.column(0))).view(np.int64))], ["s"])

    few = rows.select("text").sample(min(1.0, max(SAMPLE / n, 1 / SHARE)), 1)
    seen = map_texts(few, run, "s long", 0).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    seen = written(seen.select(F.col("s").alias("anchor"), "n"), "common")
    out = [bitmap(seen.where(F.col("n") >= COMMON << k), BITMAP - k) for k in range(LEVELS)]
    dropped(seen)
    return [b for b in out if b.any()]


def _prefixes(rows: DataFrame, held, marked=None) -> DataFrame:
    """``(s, node, n)`` of each prefix shingle, or of those that a bitmap marks."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = shingle_sets(b.column(0))
        heads = [prefix(s, held.value) for s in sets]
        if marked is not None:
            heads = [h[marked_places(marked.value, h)] for h in heads]
        times = [len(h) for h in heads]
        found = [np.concatenate(heads).view(np.int64), np.repeat(np.array([_name(s) for s in sets], np.int64), times), np.repeat(np.array([len(s) for s in sets], np.int32), times)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["s", "node", "n"])

    return map_texts(rows.select("text"), run, "s long, node long, n int", 0)


def _met(rows: DataFrame) -> DataFrame:
    """``(s, node, n, low)``: sets that share a prefix shingle with another, and the least node of its group.

    The first pass only counts, so copies fall together within tasks; a bitmap of what several sets have thins the second.
    """
    sc = rows.sparkSession.sparkContext
    held = sc.broadcast(_common(rows))
    ends = _prefixes(rows, held).groupBy("s").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    ends = written(ends.select("s", "low"), "ends")
    marked = sc.broadcast(bitmap(ends.select(F.col("s").alias("anchor")), BITMAP))
    out = written(_prefixes(rows, held, marked).distinct().join(ends, "s"), "met")
    dropped(ends)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are near copies."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def _confirmed(pairs: DataFrame, one: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of a written table ``(a, b)`` whose sets are similar; the row of each node that ``one`` names is read again, whole."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    few = one.join(named, "node", "left_semi").select("node", F.col("r.h").alias("of"), F.col("r.doc_id").alias("id"))
    # Rows with the same id and text are one text.
    same = (F.col("h") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))
    texts = written(rows.join(few, same).select("node", "text").dropDuplicates(["node"]), "texts", "zstd")
    sides = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = [similar(x, y) for x, y in zip(shingle_sets(b.column(2)), shingle_sets(b.column(3)))]
        return b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(next(sides), "a").join(next(sides), "b").select("a", "b", "text_a", "text_b")
    out = written(map_texts(both, run, "a long, b long", 2), "links")
    dropped(pairs, texts)
    return out


def parities(own: np.ndarray) -> np.ndarray:
    """The parities of a set; two sets differ in at least as many shingles as parities, or as parities folded to the shorter."""
    bits = min(max(PARITIES[0], 1 << max(0, len(own) - 1).bit_length()), PARITIES[1])
    odd = np.bincount(((own >> np.uint64(52)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _close(n: Column, m: Column) -> Column:
    """Whether two sets' sizes allow them to be similar."""
    return F.least(n, m) * SIMILAR[1] >= F.greatest(n, m) * SIMILAR[0]


def _enough(shared: Column, n: Column, m: Column) -> Column:
    """Whether two sets of sizes n and m that share so many prefix shingles can be similar."""
    t, of = SIMILAR
    least = F.ceil((n + m) * F.lit(t) / F.lit(t + of))
    return shared >= least + 1 - F.ceil(F.greatest(n, m) * F.lit(t) / F.lit(of))


def _folded(one: str, two: str) -> Column:
    """Parities ``one``, their halves put together if ``two`` has fewer. Sizes that are close differ by one halving at most."""
    half = (F.size(one) / 2).cast("int")
    both = F.zip_with(F.slice(one, 1, half), F.slice(one, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(one) > F.size(two), both).otherwise(F.col(one))


def _alike(one: str, two: str, n: Column, m: Column) -> Column:
    """Whether two sets' parities allow them to be similar."""
    t, of = SIMILAR
    apart = F.aggregate(F.zip_with(_folded(one, two), _folded(two, one), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return apart * (t + of) <= (n + m) * (of - t)


def _rooted(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """``nodes`` with the root of their component."""
    roots = tree.select(F.col("node").alias("of"), "root")
    return nodes.join(roots, F.col("node") == F.col("of"), "left").drop("of").withColumn("root", F.coalesce("root", "node"))


def _open(met: DataFrame, tree: DataFrame, odd: DataFrame) -> DataFrame:
    """``(node, s, n, root, odd)``: the sets of groups that several components share."""
    left = _rooted(met.select("s", "node", "n"), tree)
    apart = left.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("s")
    return written(left.join(apart, "s", "left_semi").join(odd, "node"), "open")


def _part(turn: int) -> Column:
    """The part of its group that a set is in at a turn: a few of its parities, other ones for each group and turn.

    Copies differ in few parities, so they mostly fall into one part; other texts of the group are spread over all parts.
    """
    step, most = PART_BITS
    h, size = F.xxhash64("s", F.lit(turn)), F.size("odd")
    word = F.element_at("odd", (F.pmod(h, size) + 1).cast("int"))
    few = F.call_function("shiftrightunsigned", word, F.pmod(h, F.lit(65 - most)).cast("int")).bitwiseAND(F.lit((1 << min(most, step * turn)) - 1))
    return size * F.lit(1 << most) + few


def _drawn(open_: DataFrame, turn: int) -> DataFrame:
    """``(a, b)``: each set with two that a hash draws from its part of each of its groups, if of other components and perhaps similar."""
    parts = open_.withColumn("part", _part(turn))
    of = F.struct(F.xxhash64("node", "s", F.lit(turn)).alias("h"), F.col("node").alias("a"), F.col("n").alias("m"), F.col("root").alias("to"), F.col("odd").alias("odds"))
    drawn = parts.groupBy("s", "part").agg(F.array(F.min(of), F.max(of)).alias("d")).select("s", "part", F.explode("d").alias("d")).select("s", "part", "d.*")
    met = parts.join(drawn, ["s", "part"]).where((F.col("root") != F.col("to")) & _close(F.col("n"), F.col("m")) & _alike("odd", "odds", F.col("n"), F.col("m")))
    return met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _across(open_: DataFrame) -> DataFrame:
    """``(a, b, n, m)``, once for each group: sets of different components that may be similar."""
    other = open_.select("s", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("to"), F.col("odd").alias("odds"))
    n, m = F.col("n"), F.col("m")
    both = open_.withColumnRenamed("node", "a").join(other, "s")
    return both.where((F.col("a") < F.col("b")) & (F.col("root") != F.col("to")) & _close(n, m) & _alike("odd", "odds", n, m)).select("a", "b", "n", "m")


def simhash_links(own: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: nodes whose fingerprints the trees link, directly or through others of a shard; candidates for confirmation."""
    nodes = own.groupBy("node").agg(F.min("fp").alias("fp"))
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    tree = linked(least.select("fp"), least.count(), radius)
    x, y = (least.select(F.col("fp").alias(f), F.col("least").alias(n)) for f, n in (("a", "p"), ("b", "q")))
    apart = tree.where("a <> b").join(x, "a").join(y, "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    equal = nodes.join(least, "fp").where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return apart.union(equal)


def near_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, node, root)`` of every row: the hash of its text, its set of shingles, and its component's name.

    Texts link at SIMILAR or more; texts with the same set are one node, so null texts and texts without words are copies
    of each other.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))

    def name(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(b.column(2))
        found = [pa.array([f(s) for s in sets], pa.int64()) for f in (_name, fingerprint)]
        bits = [parities(s) for s in sets]
        odd = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bits)]), pa.int32()), pa.array(np.concatenate(bits)))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *found, odd], ["doc_id", "h", "node", "fp", "odd"])

    own = written(map_texts(rows, name, f"doc_id {dict(rows.dtypes)['doc_id']}, h long, node long, fp long, odd array<long>", 2), "nodes")
    # Copies fall together before they are shuffled, and only once.
    one = written(own.groupBy("node").agg(F.min(F.struct("h", "doc_id")).alias("r"), F.first("odd").alias("odd")), "one")
    met = _met(rows)
    # The group's least node that is least most often, for the node that shares most with it.
    times = met.where("low < node").groupBy("node", "n", "low").agg(F.count(F.lit(1)).alias("k"))
    likely = times.groupBy("node", "n").agg(F.max(F.struct("k", F.bitwise_not("low").alias("l"))).alias("best"))
    sizes = met.where("low = node").select(F.col("node").alias("a"), F.col("n").alias("m")).distinct()
    stars = likely.select(F.bitwise_not("best.l").alias("a"), F.col("node").alias("b"), "n", "best.k").join(sizes, "a")
    stars = stars.where(_close(F.col("n"), F.col("m")) & _enough(F.col("k"), F.col("n"), F.col("m"))).select("a", "b")
    pairs = written(stars.union(simhash_links(own)).distinct(), "pairs")
    first = _confirmed(pairs, one, rows)
    tree = written(components(first), "tree")

    odd = one.select("node", "odd")
    for turn in range(TURNS):
        open_ = _open(met, tree, odd)
        pairs = written(_drawn(open_, turn), "pairs")
        drawn = pairs.count()
        links = _confirmed(pairs, one, rows)
        found = links.count()
        dropped(open_)
        if not found:
            break
        merged = written(components(tree.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)), "tree")
        dropped(tree, links)
        tree = merged
        if found < WORTH * drawn:
            break
    open_ = _open(met, tree, odd)
    n, m = F.col("n"), F.col("m")
    # All groups that two components' nodes share are open, so this counts all that their prefixes share.
    shared = _across(open_).groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("k"))
    more = _confirmed(written(shared.where(_enough(F.col("k"), n, m)).select("a", "b"), "pairs"), one, rows)
    whole = _rooted(own.drop("fp", "odd"), tree if more.isEmpty() else components(tree.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))
    dropped(met, one, open_)
    return whole


def clean(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, the one with the smallest id, all columns kept, whatever their names.

    Null ids come last; rows with equal or null ids are rows like others, told apart by their texts; of rows with the same
    id and text any one is kept. Null texts and texts without words are copies of each other; an empty table stays empty.
    """
    found = near_copies(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    hashed, first, other = fresh(docs, "_h"), fresh(docs, "_id"), fresh(docs, "_first")
    best = found.groupBy("root").agg(F.min(key).alias("f")).select(F.col("f.doc_id").alias(first), F.col("f.h").alias(other))
    kept = written(best, "kept")
    same = F.col("doc_id").eqNullSafe(F.col(first)) & (F.col(hashed) == F.col(other))
    out = docs.withColumn(hashed, F.xxhash64(F.coalesce("text", F.lit("")))).join(kept, same, "left_semi")
    copies = not found.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return (out.dropDuplicates(["doc_id", hashed]) if copies else out).select(*columns(docs))
