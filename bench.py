"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder and BENCH_CPUS the local cores. Every query runs once to warm
up and once timed; its whole result is written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from flipside.queries import QUERIES
from flipside.session import build_session

HEADLINE = (
    "surface_profile",
    "stratified_split",
    "norm_all",
    "shortcut_features",
    "token_counts",
    "ngram_counts",
    "tfidf_l2",
    "nb_scores",
    "normalization_sweep",
    "threshold_sweep",
    "flip_counts",
    "dup_label_conflicts",
    "likely_mislabels",
    "lr_scores",
    "c_sweep",
    "shortcut_models",
    "candidate_table",
    "audit_table",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
