"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tasksieve.catalog import QUERIES  # noqa: E402
from tasksieve.session import local_session  # noqa: E402

HEADLINE = [
    "flagship", "clean_notes", "mask_structural", "mask_dictionary", "extract_entities", "dedup_keep_first", "dup_count",
    "leakage_scan", "token_topk", "count_vectors", "class_tfidf", "html_to_text", "topic_centroid", "topic_coherence",
    "topic_similarity_pairs", "misfit_docs", "soft_membership", "zero_shot_assign", "silhouette", "knn_redistribute", "taxonomy_draft",
    "stratified_folds", "classification_report", "monthly_volume_topk", "stream_volume",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in only:
        times = []
        for _ in range(runs + 1):  # the first run warms up
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
            spark.catalog.clearCache()
        seconds[name] = round(statistics.median(times[1:]), 3)
    rows = spark.read.parquet(f"{folder}/documents.parquet").count()
    flagship = seconds.get("flagship")
    print(json.dumps({
        "metric": "total seconds over the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "documents": rows,
        "corpus_rows_per_sec": round(rows / flagship, 1) if flagship else None}))


if __name__ == "__main__":
    main()
