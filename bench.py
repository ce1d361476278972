"""Time the headline queries and print one JSON line.

Each query is run once to warm up and then BENCH_RUNS times (default 1); the median counts. Results
go to a sink that reads every row and column. ``BENCH_ALL=1`` times every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clauseloom.plans import QUERIES, load_all
from clauseloom.session import local_session

HEADLINE = [
    "sequence_ids",
    "flatten_assembly",
    "flatten_digest",
    "tokenize",
    "digest_clause_table",
    "segment_discussions",
    "adjacent_pairs",
    "triples_v2",
    "triples_v3",
    "bag_of_words",
    "tf_idf",
    "doc_representation",
    "gensim_tfidf",
    "cluster_tfidf",
    "word_ranking",
    "top5_words",
    "corpus_ratio",
    "class_tfidf",
    "cosine_to_centroid",
    "above_cluster_mean",
    "title_clause_metrics",
    "topk_by_metric",
    "metric_report",
    "nearest_same_speaker",
    "pair_similarity",
    "roc_auc",
    "paraphrase_mining",
    "greedy_match",
    "word_match_count",
    "variance_cluster",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    load_all()
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", "8")))

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        first = once(name)
        took = statistics.median(once(name) for _ in range(runs)) if runs else first
        seconds[name] = round(took, 3)
        print(f"{name:28s} first {first:7.2f} median {took:7.2f}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
