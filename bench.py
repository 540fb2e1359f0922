"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from ratelark.plans.catalogue import QUERIES
from ratelark.session import build_session

HEADLINE = [
    "area_rating", "portfolio_prep", "split_balanced", "fold_labels_block", "quantile_split",
    "split_distribution", "category_reduce", "one_hot", "scale_robust", "ordered_rows",
    "cc_segments", "gini_indices", "abc_sdcl", "cci_coi_cui", "spearman_weighted",
    "pointwise_metrics", "group_stats", "auto_calibration", "metrics_by_part", "calib_bin_means",
    "calib_tail_pool", "isotonic", "glm_poisson",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "ratelark-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g", spark__log__level="ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["area_rating"](spark, sf_dir).collect()      # start-up and class loading
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time",
                      "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
