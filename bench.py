"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tessella.plans import load, registry  # noqa: E402
from tessella.session import local_session  # noqa: E402

HEADLINE = [
    "X01_score_first_nms", "X03_smallest_first_nms", "X02_cross_group_nms", "X09_merge_close_points", "X07_merge_runs",
    "J01_overlap_pairs", "J02_drop_existing", "J10_contained_in_image_types", "X06_overlap_groups", "A14_coverage_score",
    "J03_styles_last_wins", "J04_dominant_colors", "A05_majority_first_seen", "O01_z_order", "K05_merged_document",
    "W01_top_k_per_image", "W02_merge_shards", "S01_detection_results", "A01_request_metrics", "A08_dataset_scores",
    "A11_average_precision", "A13_tracklet_iou", "T02_association", "P04_iou",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picks = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    load()
    # Start the JVM and its Python workers outside the measured time.
    registry.QUERIES["X01_score_first_nms"](spark, sf).limit(1).collect()
    times = {}
    for name in picks:
        t = time.time()
        # noop writes every row and column without moving them to the driver.
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    out = {"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name.removeprefix("sf")}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
