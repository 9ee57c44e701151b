"""Seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tessella import queries as core

HEADLINE = (
    "text_index_stemmed", "term_df", "postings_pos", "bool_nested", "bool_not_all", "rank_tfidf_topk", "rank_stemmed_topk",
    "batch_queries_topk", "bovw_histogram", "image_search_topk", "image_search_batch", "fusion_score_topk", "sealed_lookup",
)
#: Searches of an index that is there already, one after the other, as a session has them.
SEARCHES = 35
INDEX = "stored_search_35"


def stored(spark: SparkSession, d: str) -> float:
    """Seconds of SEARCHES searches of one stored index; building it is not counted."""
    index = core.stored_index(spark, d)
    began = time.perf_counter()
    for i in range(SEARCHES):
        index.search(core.BATCH[i % len(core.BATCH)]).collect()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = core.registry()
    seconds = {}
    for name in HEADLINE:
        query = registry[name][0]
        took = []
        for _ in range(3):
            began = time.perf_counter()
            query(spark, d).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 3)
    seconds[INDEX] = stored(spark, d)
    sf = os.path.basename(d.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
