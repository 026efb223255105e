"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from tractwise.catalog.queries import QUERIES
from tractwise.session import local_session

HEADLINE = [
    "repeat_length_per_read", "histogram_build", "instability_index", "delta_table", "wide_delta",
    "delta_plot_data", "smooth_delta", "segments_truth", "segment_auc", "dataset_features",
    "mixture_features", "train_test_split", "zscore_train", "nearest_centroid", "silhouette",
    "auc_per_dataset", "auc_overall", "roc_curve", "gam_fit", "changepoint_labels", "kmeans_train",
    "gmm_train", "hca_train",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, "bench", "16g")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["label_tau"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total wall-clock of headline queries",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
