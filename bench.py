"""Times the headline queries on one machine and prints one JSON line."""

import json
import os
import sys
import time

from tidewright.plans import catalog
from tidewright.session import local_session

HEADLINES = [
    "series_profile", "interpolate_gaps", "scaler_fit", "moving_average", "series_stats", "sensor_intervals", "label_runs",
    "events_in_segments", "continued_ranges", "criteria_chain", "joined_answers", "request_batches", "unique_graph",
    "nearest_objects", "chunk_documents", "sentence_counts", "qa_pairs", "conversation_verdicts", "numbered_dialogues",
    "context_similarity", "nearest_vectors", "duplicate_summary", "gram_matrix", "parsed_routines", "format_report", "trend_scores",
]

# Timed after the headlines and reported beside them.
MORE = ["decompose_series", "autocorrelation", "windows_max_overlap", "replacement_containers", "knowledge_pairs", "skill_pairs", "sensor_job"]


def main():
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or [*HEADLINES, *MORE]
    spark = local_session(cores, shuffle_partitions=cores, app="tidewright-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{path}/region.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    more = {} if sys.argv[1:] else {name: times.pop(name) for name in MORE}
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "more": more, "sf": os.path.basename(path.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
