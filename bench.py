"""Time the headline queries on local[$BENCH_CPUS] and print one JSON line.

Every query starts cold: shared stages are forgotten first, so each time
includes reading the star tables and building all stages it needs.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "t4_clean_trials",
    "t7_design_cells",
    "e10_observed_summary",
    "m12_keep_valid",
    "f1_cell_statistics",
    "f2b_cell_expectations",
    "f3_partial_pooling",
    "f6_closed_form_loo",
    "l2_importance_loo",
    "l4_trial_scores",
    "w1_pseudo_bma",
    "w2_pseudo_bma_bootstrap",
    "w9_stacking_steps",
    "w9b_stacking_converged",
    "d2_draw_index",
    "e7_cell_summary",
    "x18_summary",
    "k4_density_2d",
    "c5_observed_prevalence",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from twofold.plans.queries import QUERIES
    from twofold.sources.tables import forget_stages

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("twofold-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        forget_stages()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("f2b_cell_expectations")  # starts the executors and warms the JVM
    times = {name: round(run(name), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_time_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
