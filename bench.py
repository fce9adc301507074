"""Seconds of the headline queries; prints one JSON line.

Each query runs once to warm up and then three times; the median counts.  Search
reads an index that is written first, as a service does; ``builds`` has the time
and the size of that.
Results are consumed by Spark's noop sink, so that nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from pyspark.sql import SparkSession
from tarn.plans import search_queries
from tarn.plans.catalog import QUERIES
from tarn.sources.shared import shared_folder

HEADLINE = (
    "hybrid_search", "bm25_multi_field", "bm25_topk", "knn_topk", "rrf_fuse", "postings", "suggest", "facets", "url_normalize", "url_hash", "frontier_topn_by_domain", "in_batch_dedup",
    "frontier_anti_join", "html_record", "text_preprocess", "doc_keywords", "chunk_semantic", "index_priority", "rate_window", "rate_admission", "lease_fold",
    "state_counts", "peak_concurrency", "robots_can_fetch", "sitemap_crawl", "bloom_probe",
)
RUNS = 3


def _megabytes(folder: str, prefix: str) -> float:
    """Size of the local folders of this name."""
    top = Path(folder.removeprefix("file://"))
    return sum(f.stat().st_size for d in top.glob(prefix + "*") for f in d.rglob("*.parquet")) / 1e6


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    n = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, builds = {}, {}
    # what search writes once per version of its tables, and what it takes on disk
    for name, build, kept in (("search_index", search_queries.kept, "kept-index-"), ("vector_index", search_queries.kept_document_vectors, "kept-document-vectors-")):
        began = time.perf_counter()
        build(spark, sf)
        builds[name] = {"sec": round(time.perf_counter() - began, 3), "mb": round(_megabytes(shared_folder(spark), kept), 1)}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": n, "builds": builds}))


if __name__ == "__main__":
    main()
