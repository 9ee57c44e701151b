"""Sharding by extendible hashing. DataFrame functions only.

The directory is indexed by the first bits of a row's hash. A bucket is a prefix; one whose rows exceed the byte limit
splits on the next bit, and only it, until every bucket fits or holds one row. A row's bits are three 64-bit hashes one
after the other: of its key, of its key and text, and of its place in the table, so that rows of one key, and equal rows, can
be parted as well. Directory depth and shards depend on the data; the shards cover all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import dropped, fresh, written

LIMIT = 1 << 20
#: Bits that one pass over the bytes can split on.
STRIDE = 12
BITS = 192


def _prefix(n: int) -> Column:
    """The first n bits of a row as a string of 0 and 1."""
    return F.substring("bits", 1, n)


def _bits(c: Column) -> Column:
    return F.lpad(F.bin(c), 64, "0")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """``(prefix, bytes, docs)``: the buckets, one row each; prefixes are free of each other.

    Each round adds up the bytes by the next STRIDE bits of the rows that are still too many, and keeps, of all prefixes of
    those cells, the shortest that fits. Rounds go on over the rest only: log of the largest bucket, not of all rows.
    """
    done = None
    pending, base = sizes.select("bits", "n_bytes"), 0
    parts: list[DataFrame] = []
    while True:
        depth = min(BITS, base + STRIDE)
        cells = pending.groupBy(_prefix(depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        steps = F.sequence(F.lit(base), F.lit(depth))
        rolled = (
            cells.select(F.explode(F.transform(steps, lambda n: F.struct(n.alias("depth"), F.expr("''").alias("_")))).alias("s"), "cell", "bytes", "docs")
            .select(F.col("s.depth").alias("depth"), F.expr("substring(cell, 1, s.depth)").alias("prefix"), "bytes", "docs")
            .groupBy("depth", "prefix")
            .agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        )
        fits = (F.col("bytes") <= limit) | (F.col("docs") == 1) | (F.col("depth") == BITS)
        nodes = written(rolled.withColumn("fits", fits), "nodes")
        parents = nodes.where(~F.col("fits")).select(F.col("prefix").alias("up"), F.col("depth").alias("up_depth"))
        parent = F.expr("substring(prefix, 1, depth - 1)")
        inner = nodes.where(F.col("fits") & (F.col("depth") > base)).join(parents, (parent == F.col("up")) & (F.col("depth") - 1 == F.col("up_depth")), "left_semi")
        top = nodes.where(F.col("fits") & (F.col("depth") == base)) if base == 0 else nodes.where(F.lit(False))
        parts.append(written(inner.union(top).select("prefix", "bytes", "docs"), "buckets"))
        full = nodes.where(~F.col("fits") & (F.col("depth") == depth)).select(F.col("prefix").alias("cell"))
        again = not full.isEmpty()
        if again:
            rest = written(pending.join(full, _prefix(depth) == F.col("cell"), "left_semi"), "rest")
        dropped(nodes, *([done] if done is not None else []))
        if not again:
            break
        pending, done, base = rest, rest, depth
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """``(doc_id, n_bytes, shard, depth, shard_bytes, shard_docs)`` of every row; ``shard`` is the bucket's prefix.

    A column named by ``row``, which must tell all rows apart, is added as ``row`` and parts equal rows.

    A row's bytes are those of its text, 0 for null. A row above the limit is alone in its shard. Equal rows are parted
    by their place in the table. One bucket that holds all has the empty prefix. Other columns are left out.
    """
    value, size = F.col(key), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    own = F.monotonically_increasing_id() if row is None else F.col(row)
    hashes = (F.xxhash64(value).alias("h1"), F.xxhash64(value, F.coalesce(text, F.lit("")), F.lit(1)).alias("h2"), F.xxhash64(own, F.lit(2)).alias("h3"))
    more = [] if row is None else [own.alias("row")]
    stored = written(docs.select(value.alias("doc_id"), size.alias("n_bytes"), *hashes, *more), "sized")
    rows = stored.withColumn("bits", F.concat(_bits(F.col("h1")), _bits(F.col("h2")), _bits(F.col("h3")))).drop("h1", "h2", "h3")
    buckets = directory(rows, limit).select("prefix", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"), F.length("prefix").alias("depth"))
    # Prefixes are free of each other, so a row meets its bucket at one of the depths that occur: a handful.
    depths = sorted(r.depth for r in buckets.select("depth").distinct().collect())
    tried = rows.withColumn("prefix", F.explode(F.array(*[_prefix(d) for d in depths]))) if depths else rows.withColumn("prefix", F.lit(""))
    return tried.join(buckets, "prefix").select("doc_id", "n_bytes", F.col("prefix").alias("shard"), "depth", "shard_bytes", "shard_docs", *(["row"] if row is not None else []))


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Rows in one folder for each shard, ``shard=b`` and its prefix; a shard is written by one task, bounded by the limit or one row.

    All columns are kept, whatever their names; where the input has a column of the folder's name, the folder's gets
    underscores until it has one of its own. Null texts count no bytes.
    """
    row, folder = fresh(docs, "_row"), fresh(docs, "shard")
    staged = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    dealt = shards(staged, limit, row=row).select(F.col("row").alias(row), F.concat(F.lit("b"), "shard").alias(folder))
    staged.join(dealt, row).drop(row).repartition(folder).write.partitionBy(folder).parquet(path)


def digest(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    return shards(docs, limit)
