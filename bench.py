"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores, BENCH_QUERIES a
comma-separated choice of queries.  Each query runs once in a warm session and is written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from readframe.queries.catalog import QUERIES  # noqa: E402
from readframe.session import local_session  # noqa: E402

HEADLINE = [
    "gc_bin_rollup",
    "exact_match_metrics",
    "iou_match_counts",
    "codon_confusion",
    "start_stop_detection",
    "indel_matches",
    "permutation_test",
    "read_cds_overlap",
    "merged_regions",
    "checked_annotations",
    "md_errors",
    "translate_frames",
    "read_windows",
    "label_segments",
    "genome_composition",
    "decoded_labels",
    "family_split",
    "chained_segments",
    "called_features",
    "fragments_in_proteome",
    "labelled_reads",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "readframe-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
