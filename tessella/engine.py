"""A stored text and image index: set up, add, search, persist, clear."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from uuid import uuid4

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import codebooks, fusion, text_index, text_search, vision
from .plans import boolean
from .segments import Manifest

#: Folders of a large segment, by a hash of the term, so a query reads the folders of its terms only; a small one has fewer.
BUCKETS = 256
#: Documents of a segment of the lowest tier, at most, when it is added at once.
SMALL = 10_000
#: Shuffled bytes that a task sorts when a segment is written, about; a few times as much in its memory.
TASK_BYTES = 16 << 20
POSTINGS = "doc_id long, term string, tf int"
STATS = "term string, df long, max_tf int"


def _bucket(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _bucket_of(term: str, n: int) -> int:
    """The same as ``_bucket``, for one term, without a job."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % n


class TextIndex:
    """Postings, documents and term statistics under one folder, in segments that a manifest names.

    An add is one segment and comes with a number; the same number again replaces it, so a retried add counts once. As soon as
    ``fan`` segments of a tier exist they are merged into one of the next tier, so many small adds leave a bounded number of
    files. The number of an add that was merged is done with: adding it again does nothing. Searches read the segments of
    one manifest, while others are added or merged, and take document frequencies and the number of documents from storage.

    Document ids must be new; rows without an id are left out. A document without terms still counts in the universe of NOT
    and in N.
    """

    def __init__(self, spark: SparkSession, path: str, stop_words: Iterable[str] | None = None, fan: int = 8):
        if fan < 2:
            raise ValueError("fan must be 2 or more")
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self.stop_words = X.default_stop_words(spark) if stop_words is None else sorted(stop_words)
        self.manifest = Manifest(spark, self.path)

    def create(self) -> TextIndex:
        """An empty index in place of whatever there is."""
        self.manifest.change(lambda live: [])
        self.manifest.vacuum(0)
        return self

    clear = create

    def _tier(self, docs: int) -> int:
        tier, most = 0, SMALL
        while docs > most:
            tier, most = tier + 1, most * self.fan
        return tier

    def _write(self, name: str, table: str, rows: DataFrame, buckets: int) -> list[int]:
        """Write a table clustered by bucket and term; which buckets it has.

        Spark sizes the tasks by their data, TASK_BYTES each: small buckets share one, and a bucket with a very common term is
        split. So a task's memory does not grow with the segment.
        """
        where = f"{self.path}/segments/{name}/{table}"
        order = [c for c in ("bucket", "term", "doc_id") if c == "bucket" or c in rows.columns]
        clustered = rows.withColumn("bucket", _bucket("term", buckets)).hint("rebalance", "bucket").sortWithinPartitions(*order)
        conf, most = self.spark.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        given = conf.get(most)
        conf.set(most, str(TASK_BYTES))
        try:
            clustered.write.mode("overwrite").partitionBy("bucket").parquet(where)
        finally:
            conf.set(most, given)
        found = [n for n, _ in self.manifest.names(f"segments/{name}/{table}")]
        return sorted(int(n.split("=")[1]) for n in found if n.startswith("bucket="))

    def _segment(self, kind: str, ids: DataFrame, postings: DataFrame, batches: list[int], stats: DataFrame | None = None, tier: int = 0) -> dict:
        """Write a segment that no manifest names yet."""
        name = f"{kind}-{uuid4().hex}"
        where = f"{self.path}/segments/{name}"
        ids.hint("rebalance").write.parquet(f"{where}/docs")
        n = self.spark.read.schema("doc_id long").parquet(f"{where}/docs").count()
        tier = max(tier, self._tier(n))
        buckets = min(BUCKETS, 4**tier)
        full = self._write(name, "postings", postings, buckets)
        if stats is None:
            own = self._read("postings", POSTINGS, [{"name": name}])
            stats = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"))
        self._write(name, "stats", stats, buckets)
        return {"name": name, "tier": tier, "docs": n, "batches": batches, "buckets": buckets, "full": full}

    def add(self, docs: DataFrame, batch: int, doc_id: str = "doc_id", text: str = "text") -> None:
        """Index a batch of documents as a segment of its own, then merge what is due."""
        if any(batch in s["batches"] and len(s["batches"]) > 1 for s in self.manifest.read()[1]):
            return
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
        made = self._segment(f"add{batch}", rows.select("doc_id"), X.term_counts(rows, self.stop_words), [batch])
        self.manifest.change(lambda live: [s for s in live if s["batches"] != [batch]] + [made])
        self.compact()

    def compact(self, all_: bool = False) -> None:
        """Merge tiers that are full, lowest first; with ``all_``, all segments into one.

        Frequencies and greatest counts are merged from the segments' own; postings are read once and written once. A merge
        whose segments another writer has replaced meanwhile is dropped.
        """
        while True:
            live = self.manifest.read()[1]
            tiers = sorted({s["tier"] for s in live})
            due = [[s for s in live if s["tier"] == t] for t in tiers]
            chosen = live if all_ and len(live) > 1 else next((d for d in due if len(d) >= self.fan), None)
            if not chosen:
                return
            stats = self._read("stats", STATS, chosen).groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"))
            batches = sorted(b for s in chosen for b in s["batches"])
            tier = max(s["tier"] for s in chosen) + 1
            made = self._segment("merge", self._read("docs", "doc_id long", chosen), self._read("postings", POSTINGS, chosen), batches, stats, tier)
            gone = {s["name"] for s in chosen}
            self.manifest.change(lambda now: [s for s in now if s["name"] not in gone] + [made] if gone <= {s["name"] for s in now} else None)
            if all_:
                return

    def vacuum(self, grace: float = 3600.0) -> list[str]:
        """Delete merged and replaced segments that no reader of the last ``grace`` seconds can have begun with."""
        return self.manifest.vacuum(grace)

    def _read(self, table: str, schema: str, live: list[dict], terms: Iterable[str] | None = None) -> DataFrame:
        """A table of some segments; with ``terms``, of the folders that hold them only."""
        paths = []
        for s in live:
            where = f"{self.path}/segments/{s['name']}/{table}"
            if terms is None:
                paths.append(where)
            else:
                wanted = {_bucket_of(t, s["buckets"]) for t in terms}
                paths += [f"{where}/bucket={b}" for b in s["full"] if b in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    @property
    def docs(self) -> DataFrame:
        return self._read("docs", "doc_id long", self.manifest.read()[1])

    @property
    def counts(self) -> DataFrame:
        return self._read("postings", POSTINGS, self.manifest.read()[1])

    def statistics(self, terms: Iterable[str] | None = None) -> DataFrame:
        """Stored ``(term, df, max_tf)``: documents that have the term, and its greatest count in one."""
        return self._statistics(self.manifest.read()[1], terms)

    def _statistics(self, live: list[dict], terms: Iterable[str] | None) -> DataFrame:
        own = self._read("stats", STATS, live, terms)
        own = own if terms is None else own.where(F.col("term").isin(*terms))
        return own.groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"))

    def _known(self, terms: Sequence[str]) -> tuple[DataFrame, DataFrame, dict]:
        """Postings of the terms, all documents, and the stored statistics, of one manifest."""
        live = self.manifest.read()[1]
        how = {"stats": self._statistics(live, terms).select("term", "df"), "size": sum(s["docs"] for s in live)}
        return self._read("postings", POSTINGS, live, terms), self._read("docs", "doc_id long", live), how

    def search(self, query: str, k: int | None = text_search.TOP_K) -> DataFrame:
        tree = boolean.parse(query, X.query_word)
        counts, docs, how = self._known(sorted(boolean.words(tree)))
        return text_search.search(counts, docs, tree, k, **how)

    def search_batch(self, queries: Sequence[tuple[int, str]], k: int = text_search.TOP_K) -> DataFrame:
        counts, docs, how = self._known(sorted({t for _, q in queries for t in text_search.named_terms(q, X.query_word)}))
        return text_search.search_batch(counts, docs, queries, k, X.query_word, **how)

    def postings(self) -> DataFrame:
        return text_index.postings(self.counts)

    def size(self) -> int:
        return self.counts.count()


class ImageIndex:
    """Visual-word histograms as a Parquet table, with a codebook and its technique."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self, k: int, dim: int, technique: str = "kmeans") -> ImageIndex:
        """Parameters of an empty index."""
        if technique not in ("kmeans", "lsh"):
            raise ValueError(f"unknown technique {technique!r}")
        meta = json.dumps({"k": k, "dim": dim, "technique": technique})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")
        empty = self.spark.createDataFrame([], "image_id long, centre int, tf long, batch long")
        empty.write.mode("overwrite").parquet(f"{self.path}/hist")
        return self

    @property
    def meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/meta").first().value)

    def clear(self) -> ImageIndex:
        m = self.meta
        return self.create(m["k"], m["dim"], m["technique"])

    def set_codebook(self, codebook: DataFrame) -> None:
        codebook.write.mode("overwrite").parquet(f"{self.path}/codebook")

    @property
    def codebook(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codebook")

    def train(self, descriptors: DataFrame, seed: int = 0) -> None:
        """A codebook by the index's technique: k-means over descriptors, or random hyperplanes."""
        from .functions.vector import gaussian_codebook

        m = self.meta
        lsh = m["technique"] == "lsh"
        made = gaussian_codebook(self.spark, m["k"], m["dim"], seed) if lsh else codebooks.kmeans_codebook(descriptors, m["k"], seed)
        self.set_codebook(made)

    def add(self, descriptors: DataFrame, batch: int) -> None:
        hist = vision.histogram(vision.assign(descriptors, self.codebook, self.meta["technique"]))
        out = hist.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite")
        out.partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/hist")

    @property
    def hist(self) -> DataFrame:
        return self.spark.read.schema("image_id long, centre int, tf long, batch long").parquet(f"{self.path}/hist")

    def search(self, descriptors: DataFrame, k: int | None = vision.TOP_K) -> DataFrame:
        """Rank the stored images for one query image's descriptors."""
        q = vision.histogram(vision.assign(descriptors, self.codebook, self.meta["technique"]))
        return vision.search(self.hist, q.groupBy("centre").agg(F.sum("tf").alias("qf")), k)

    def statistics(self) -> DataFrame:
        """``(centre, df)``, to be stored and given to searches."""
        return vision.centre_frequencies(self.hist)


def search_multimodal(
    texts: TextIndex, images: ImageIndex, query: str, descriptors: DataFrame, mode: str = "score", empty_word: str = "empty"
) -> DataFrame:
    """Fused ranking of a text query and an image query; an empty text query becomes ``empty_word``."""
    found = texts.search(query.strip() or empty_word)
    seen = images.search(descriptors).withColumnRenamed("image_id", "doc_id")
    return fusion.fuse(found, seen, mode)
