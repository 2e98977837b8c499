"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))  # Python workers import the library too

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from latticework import catalog  # noqa: E402
from latticework.session import build_session  # noqa: E402

HEADLINES = [
    "flagship_label_summary", "w1_label_top_share", "p6_group_rules", "a3_missingness", "a6_numeric_summary", "a9_quadrant_shares", "a10_correlations",
    "a12_filter_audit", "a1_stack_median", "a18_a20_prediction_metrics_by_group", "a21_run_summary", "a23_calibration", "w4_w5_top_flags",
    "w6_prediction_labels", "w7_map_labels", "w8_frontier", "w9_previous_run", "w14_stratified_sample_counts", "w16_balanced_folds", "w19_spearman",
    "g9_rank_in_group", "j2_replace_columns", "j3_pair_metrics", "j11_quantile_bin_means", "m7_fold_baselines", "w2_window_mean", "g13_neighbourhood",
    "d1_distance_to_marked", "w20_gaussian_smooth", "g1_polygon_grid", "g14_reconstruct_grid", "m8_newton_logistic_all_folds", "g15_assembled_cells", "m1_m2_m6_logistic_heldout", "m11_within_group_models",
    "m16_held_out_alignment",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    every = catalog.queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM paths
    every[HEADLINES[0]](spark, folder).count()  # Python workers and code paths that all queries share
    seconds, rows, errors = {}, {}, {}
    for name in HEADLINES:
        begun = time.perf_counter()
        try:
            counted = Observation(name)
            every[name](spark, folder).observe(counted, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        except Exception as error:  # one failing query must not lose the others' figures
            errors[name] = f"{type(error).__name__}: {error}"[:300]
            print(f"{name} failed: {errors[name]}", file=sys.stderr, flush=True)
            continue
        seconds[name] = round(time.perf_counter() - begun, 3)
        rows[name] = counted.get["n"]
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows": rows, "errors": errors,
                      "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
